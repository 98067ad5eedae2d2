"""Folders of recordings: listed by Spark's file source or by tasks, names and times only; and written by tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, modified, bytes) of all files below ``root``, those and folders whose names begin with a dot or an underscore left
    out. Executors list in parallel where there are many folders; no content is read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        read = read.option("pathGlobFilter", pattern)
    return read.load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def write_files(rows: DataFrame, root: str, order: list[str]) -> None:
    """Writes rows (path, line) as files of lines at their paths below ``root``, in the order of columns that may stand beside them.

    For very many small files: a task walks through its sorted rows and writes each file where it belongs, once, so no file is
    renamed by the driver when all are done. A task that is run again writes the same names again.
    """

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = FileSystem.from_uri(root)
        last, files = None, 0
        with ExitStack() as opened:
            for x in blocks:
                for path, lines in x.groupby("path", sort=False)["line"]:
                    if path != last:  # a file can go on in the next block
                        opened.close()
                        fs.create_dir(f"{top}/{path}".rpartition("/")[0])
                        out = opened.enter_context(fs.open_output_stream(f"{top}/{path}"))
                        last, files = path, files + 1
                    out.write(("\n".join(lines) + "\n").encode())
        yield pd.DataFrame({"files": [files]})

    sorted_ = rows.repartition("path").sortWithinPartitions("path", *order).select("path", "line")
    sorted_.mapInPandas(run, "files long").agg(F.sum("files")).collect()


def listed_below(spark: SparkSession, root: str, folders: DataFrame) -> DataFrame:
    """(path, modified, bytes) of all files below folders (folder) of ``root``, at any depth. Each folder is listed by a task, and
    what it finds stays with the executors; folders that are not there hold nothing."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = FileSystem.from_uri(root)
        for x in blocks:
            for folder in x["folder"]:
                found = fs.get_file_info(FileSelector(f"{top}/{folder}", recursive=True, allow_not_found=True))
                each = [(root + i.path[len(top) :], i.mtime, i.size) for i in found if i.type == FileType.File]
                yield pd.DataFrame(each, columns=["path", "modified", "bytes"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return folders.select("folder").repartition(n, "folder").mapInPandas(run, "path string, modified timestamp, bytes long")


def written_name(path: Column) -> Column:
    """The name of the table that a part file belongs to: folders ``key=value`` as their values, without the part's own name."""
    whole = F.regexp_replace(path, r"/part-[^/]*$", "")
    return F.regexp_replace(whole, r"/[^/=]*=", "/")


def resumable(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done: what a run that broke off has left to do."""
    return rows.join(done.select(key), key, "left_anti")
