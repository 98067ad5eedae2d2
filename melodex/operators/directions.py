"""Rising and falling patterns: parsing, lookup by name, and how far recordings keep to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.adapters import note_order
from .joins import first_wins
from .names import alike

# The letters of the twelve steps above the tonic.
LETTERS = ["Ss", "r", "R", "g", "G", "m", "M", "Pp", "d", "D", "n", "N"]
#: Patterns are a dimension: up to so many are broadcast, beyond Spark chooses.
BROADCAST_PATTERNS = 100_000


def presence(text: E.ColumnOrName) -> Column:
    """Of each of the twelve steps whether one of its letters stands anywhere in the text; none in a null text."""
    has = lambda letters: F.coalesce(E.col(text).rlike(f"[{letters}]"), F.lit(False)).cast("int")
    return F.array(*[has(x) for x in LETTERS])


def patterns(rows: DataFrame, name: str, up: str, down: str, order: str) -> DataFrame:
    """(key, name, up_text, down_text, up, down, place) of a table's rows; of names that are alike the first row counts, and rows
    without a name none. place: the row's place in the table."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    read = rows.select(E.normal_name(F.trim(F.col(name))).alias("key"), text(name).alias("name"), text(up).alias("up_text"), text(down).alias("down_text"), F.col(order).alias("place"))
    first = first_wins(read.where("key != ''"), "key", ["place"])
    return first.withColumns({"up": presence("up_text"), "down": presence("down_text")})


def aligned(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, source, up_text, down_text, place) of names (name, place) with a pattern: of names that are alike the first, in
    their own order."""
    first = first_wins(names.withColumn("key", E.normal_name("name")).where("key != ''"), "key", ["place"])
    return first.join(known.select("key", F.col("name").alias("source"), "up_text", "down_text"), "key").select("name", "source", "up_text", "down_text", "place")


def pattern_for(wanted: DataFrame, known: DataFrame, names: str = "names") -> DataFrame:
    """Adds key and how: for a comma list of names the pattern of the first that has one of its name; else, for the first name
    that holds or is held by some pattern's name, the first such pattern in the table; null if there is none."""
    each = wanted.select(names, F.posexplode(F.split(names, ",")).alias("at", "one")).withColumn("one", E.normal_name(F.trim(F.col("one"))))
    each = each.where("one != ''").distinct()
    k = known.select("key", F.col("place").alias("in_table"))
    exact = each.join(k, F.col("one") == F.col("key")).groupBy(names).agg(F.min_by("key", "at").alias("exact"))
    rest = each.join(exact, names, "left_anti")
    met = alike(rest, k, "one", "key").join(k, "key").join(rest, "one")
    loose = met.groupBy(names).agg(F.min_by("key", F.struct("at", "in_table")).alias("loose"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "contains").otherwise("none")
    return wanted.join(exact, names, "left").join(loose, names, "left").withColumn("key", F.coalesce("exact", "loose")).withColumn("how", how).drop("exact", "loose")


def edges(notes: DataFrame, within: list[str]) -> DataFrame:
    """(recording_id, pc, up, down): how often each note is reached from below and above, by rounded pitches."""
    at = E.half_even("midi")
    rows = notes.withColumn("_m", at).withColumn("_b", F.lag(at).over(note_order(*within))).where("_b != _m")
    return rows.groupBy("recording_id", "pc").agg(F.count_if(F.col("_m") > F.col("_b")).alias("up"), F.count_if(F.col("_m") < F.col("_b")).alias("down"))


def conformance(reached: DataFrame, expected: DataFrame, least: int = 3) -> DataFrame:
    """(recording_id, notes, matched, total, score, missing_up, missing_down, unexpected_up, unexpected_down).

    reached: (recording_id, pc, up, down); expected: (recording_id, up, down) of twelve flags each. A note reached at least
    ``least`` times is checked twice: whether it is reached from below, and from above, as the pattern has it. Recordings
    without such a note score 0.
    """
    want = expected.select("recording_id", F.posexplode(F.arrays_zip(F.col("up").alias("u"), F.col("down").alias("d"))).alias("pc", "x"))
    rows = want.join(reached, ["recording_id", "pc"], "left").select("recording_id", "pc", (F.col("x.u") > 0).alias("want_up"), (F.col("x.d") > 0).alias("want_down"), F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))
    rows = rows.withColumns({"enough": F.col("up") + F.col("down") >= least, "is_up": F.col("up") > 0, "is_down": F.col("down") > 0})
    names = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("enough") & cond, F.struct("pc", E.label_of(F.col("pc")).alias("l"))))), lambda x: x["l"]), ",")
    hit = lambda d: (F.col("enough") & (F.col(f"is_{d}") == F.col(f"want_{d}"))).cast("int")
    out = rows.groupBy("recording_id").agg(
        F.count_if("enough").alias("notes"), F.sum(hit("up") + hit("down")).alias("matched"),
        *[names(F.col(f"want_{d}") & ~F.col(f"is_{d}")).alias(f"missing_{d}") for d in ("up", "down")],
        *[names(~F.col(f"want_{d}") & F.col(f"is_{d}")).alias(f"unexpected_{d}") for d in ("up", "down")],
    )
    return out.withColumn("total", 2 * F.col("notes")).withColumn("score", F.round(F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)), 3))


def summary(counted: DataFrame, best: dict[str, int]) -> DataFrame:
    """(kind, pattern, n, place) of (kind, pattern, n): the commonest of each kind, as many as ``best`` says."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "pattern"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in best.items() for x in kv]), F.col("kind"))
    return counted.withColumn("place", place).where(F.col("place") <= most)
