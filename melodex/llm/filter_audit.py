"""Filter interaction audit: what each of five filters takes away in every order in which they can be applied.

A document is a mask of the filters that it fails, and documents of one part and mask count as one cell, so all orders are worked
out on 32 cells a part, whatever the documents. Higher-order functions fold each cell over the array of the 120 orders: 600
structs, weighted by the cell's counts. The structs of a part's cells are added up element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, fresh, table

FILTERS = "ABCDE"
SPACE = "\t\n\x0b\f\r "
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: str) -> dict[str, Column]:
    """The conditions of a single text, null taken as empty; E compares texts and is none of them."""
    x = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.translate(x, SPACE, " " * len(SPACE)), " "), lambda w: w != "")
    return {
        "words": words,
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * F.length(F.regexp_replace(x, f"[^{UPPER[0]}-{UPPER[-1]}]+", "")) > 3 * F.length(x),
        "D": x.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(part, mask, good, toxic), a row for each document: bit i of mask is set if it fails the filter i of ``FILTERS``.

    The least id of each text is found by partial sums over a digest, and only texts found twice are joined back.
    """
    found = failures(text)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"), F.col(text), found["words"].alias("words"))
    slim = rows.select("id", "part", sum((found[x].cast("int") * (1 << i) for i, x in enumerate("ABCD")), F.lit(0)).alias("mask"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    twice = slim.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = slim.join(twice, "digest", "left").join(known, "id", "left")
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    truth = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return met.select("part", (F.col("mask") + later.cast("int") * 16).alias("mask"), truth("good").alias("good"), truth("toxic").alias("toxic"))


def _orders() -> Column:
    return F.split(F.lit(" ".join("".join(x) for x in permutations(FILTERS))), " ")


def _steps(order: Column) -> Column:
    """What the five steps of an order do to the cell of the columns mask, n, good and toxic."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    bit = lambda step: F.element_at(bits, F.ascii(F.substring(order, step, F.lit(1))) - 64)

    def one(step: Column) -> Column:
        earlier = F.aggregate(F.sequence(F.lit(0), step - 1), F.lit(0), lambda m, s: F.when(s > 0, m.bitwiseOR(bit(s))).otherwise(m))
        fails = F.col("mask").bitwiseAND(bit(step)) != 0
        passed = F.col("mask").bitwiseAND(earlier) == 0
        weight = lambda when, n="n": F.when(when, F.col(n)).otherwise(F.lit(0).cast("long"))
        return F.struct(
            order.alias("filter_order"), step.alias("step"),
            weight(passed & ~fails).alias("kept"), weight(passed & fails).alias("removed"), weight(fails & ~passed).alias("redundant"),
            weight(F.col("mask") == bit(step)).alias("unique_fails"), weight(passed & fails, "good").alias("good_lost"), weight(passed & fails, "toxic").alias("toxic_lost"),
        )

    return F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), one)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part.

    A null text is empty, a null language the part '' (as an empty one). A null id is smaller than none, so its document
    fails E never and makes no other fail; rows that share an id never make each other fail. A label row of a null id is of
    no document; of several label rows of an id each flag counts if one has it. Repeated rows are documents of their own.
    Empty table: no rows. Other columns are ignored; whole texts are read.
    """
    cells = masks(docs, labels, key, text, lang).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    folded = cells.select("part", F.flatten(F.transform(_orders(), _steps)).alias("steps"))
    add = lambda a, b: F.struct(a["filter_order"].alias("filter_order"), a["step"].alias("step"), *[(a[c] + b[c]).alias(c) for c in COUNTS])
    gathered = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))  # 32 at most
    summed = gathered.select("part", F.aggregate(F.slice("cells", 2, 1 << len(FILTERS)), F.col("cells")[0], lambda sums, cell: F.zip_with(sums, cell, add)).alias("steps"))
    letter = lambda s: F.substring(s["filter_order"], s["step"], F.lit(1))
    share = lambda x: F.aggregate(F.filter("steps", lambda s: letter(s) == x), F.lit(0).cast("long"), lambda n, s: n + s["removed"])
    shares = F.create_map(*[y for x in FILTERS for y in (F.lit(x), share(x))])
    rows = summed.select("part", shares.alias("shares"), F.explode("steps").alias("s"))
    return rows.select("part", "s.*", F.col("shares")[letter(F.col("s"))].alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
_SPACE = "[^\\x20\\x09-\\x0D]+"
ORACLE = {
    "op13_filter_audit": f"""
    WITH known AS (
        SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    texts AS (
        SELECT doc_id AS id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w
        FROM documents),
    least AS (SELECT x, min(id) AS least FROM texts GROUP BY 1),
    fails AS (
        SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
            100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d,
            coalesce(id > least, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
        FROM texts JOIN least USING (x) LEFT JOIN known USING (id)),
    cells AS (
        SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (
        SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order
        FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
        JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
    failed AS (
        SELECT part, n, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
            CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS f
        FROM cells),
    steps AS (
        SELECT part, filter_order, step, n, good, toxic, f, contains(f, filter_order[step]) AS fails, filter_order[step] AS l,
            length(translate(f, filter_order[1:step - 1], '')) = length(f) AS passed
        FROM failed, orders, range(1, 6) AS s(step)),
    summed AS (
        SELECT part, filter_order, step::INT AS step, l, coalesce(sum(n) FILTER (passed AND NOT fails), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (passed AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND NOT passed), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (f = l), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (passed AND fails), 0)::BIGINT AS good_lost,
            coalesce(sum(toxic) FILTER (passed AND fails), 0)::BIGINT AS toxic_lost
        FROM steps GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
    FROM summed"""
}
