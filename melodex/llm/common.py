"""What the operators of this subpackage share: the shared folder, cut lineage, text columns and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local master
    (tests); on a cluster an error, as a folder of one machine would lose what the others write."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a table is written that Python made.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches than the session's, for the memory of executors; the session's are put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        at = jvm.org.apache.hadoop.fs.Path(x)
        at.getFileSystem(conf).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken, out = {x.lower() for x in df.columns}, []
    for x in names:
        while x.lower() in taken:
            x = "_" + x
        taken.add(x.lower())
        out.append(x)
    return out


#: Texts that are worked through at once. Spark itself bounds an Arrow batch by rows and by bytes (64 MB).
SLICE = 512


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType, setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` by ``fn`` on slices of few rows, with what ``setup`` makes once in each task if there is one. Columns that
    ``fn`` hands on stay Arrow's: ids never pass through floating point, whatever nulls are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = () if setup is None else (setup(),)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                yield from fn(batch.slice(i, SLICE), *more)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def record(**columns: object) -> pa.RecordBatch:
    """A batch of Arrow or NumPy arrays or lists."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def copy_of(text: Column) -> Column:
    """A hash that tells texts of one id apart; null for a null text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fold(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` of two long columns: (node, component), component the least node.

    Alternates the large-star and small-star steps until no edge changes, then every edge joins a node to its
    component's least node. Each round is two joins on the node, written to the shared folder; no node's neighbours
    are ever gathered into one row. Nodes without edges are not listed.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    now = written(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct(), "edges", path)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, path = path, new_path(spark, "edges")
        now = written(small.union(least.select("u", "m")).where("u > v").distinct(), "edges", path)
        remove(spark, [last])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
