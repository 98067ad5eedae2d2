"""URL filters: host and path rules, and a Bloom filter cascade for a long list of keys.

The first level of the cascade encodes the listed keys, the second those other keys of the corpus that pass the first by
chance, the third the listed keys that pass the second, and so on until nothing passes wrongly. As the levels are built
over all keys of the corpus, membership is exact for each of them, and no key is joined with the list. A level is dealt
into shards of bounded size by a hash of the key, each an array of 64-bit words. A cascade of bounded size is one value of a
scalar subquery, so that pages are judged without a join; a larger one is met by shard. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, fresh, table, written

#: Host, path and verdict of the rules in production.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# The unwanted sites whose pages make the production list.
SITES = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")
#: A cascade of up to so many bytes goes to each task whole; beyond, rows meet their shard in a shuffle.
WHOLE_BYTES = 4_000_000
#: Keys of a shard: a row that meets its shard carries at most about a byte for each.
SHARD_KEYS = 1_000
BITS_PER_KEY, HASHES = 8, 5


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def _positions(key: Column, level: int, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(64 * words)) for i in range(HASHES)]


@dataclass
class Cascade:
    """``filters``: shard and, for each level, ``level_i``, its words. ``words[i]``: how many a shard of level i + 1 has."""

    shards: int
    words: list[int] = field(default_factory=list)
    filters: DataFrame | None = None

    def size(self) -> int:
        return 8 * self.shards * sum(self.words)

    def member(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with a boolean column: whether the key is listed. Exact for keys of the universe."""
        if not self.words:
            return rows.withColumn(name, F.lit(False))
        levels = [f"level_{i + 1}" for i in range(len(self.words))]
        if self.size() <= WHOLE_BYTES:
            every = self.filters.agg(F.sort_array(F.collect_list(F.struct("shard", *levels)))).scalar()
            (mine,) = fresh(rows, "shard")
            met = rows.withColumn(mine, F.get(every, _shard(key, self.shards).cast("int")))  # a column, so that it is asked for once
            return met.select(*rows.columns, self._answer(key, [F.col(mine).getField(x) for x in levels]).alias(name))
        shard, *renamed = fresh(rows, "shard", *levels)
        filters = self.filters.withColumnsRenamed(dict(zip(["shard", *levels], [shard, *renamed], strict=True)))
        met = rows.withColumn(shard, _shard(key, self.shards)).join(filters, shard, "left")
        return met.select(*rows.columns, self._answer(key, [F.col(x) for x in renamed]).alias(name))

    def _answer(self, key: Column, levels: list[Column]) -> Column:
        """Listed if the first level that the key does not pass is an even one; so of the level after the last."""
        answer = F.lit(len(self.words) % 2 == 1)
        for i in reversed(range(len(self.words))):
            answer = F.when(~_passes(levels[i], key, i + 1, self.words[i]), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def _passes(words: Column, key: Column, level: int, n: int) -> Column:
    """Whether all bits of the key are set."""
    bits = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), p % 64) == 1 for p in _positions(key, level, n)]
    return reduce(lambda a, b: a & b, bits)


def _encode(members: DataFrame, level: int, shards: int, words: int) -> DataFrame:
    """(shard, level_<level>): the dense words of each shard; words without a bit are zero."""
    spark = members.sparkSession
    set_bits = members.select("shard", F.explode(F.array(*_positions(F.col("key"), level, words))).alias("p")).select("shard", F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, int(p % 64))").alias("bits"))
    blank = spark.range(shards * words).select(F.floor(F.col("id") / words).alias("shard"), (F.col("id") % words).alias("word"), F.lit(0).cast("long").alias("bits"))
    each = set_bits.unionByName(blank).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    return each.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias(f"level_{level}"))


def build(universe: DataFrame) -> Cascade:
    """A cascade over the distinct rows (key, listed)."""
    total = universe.count()
    made = Cascade(shards=max(1, -(-total // SHARD_KEYS)))
    keys = written(universe.withColumn("shard", _shard(F.col("key"), made.shards)), "keys")
    inside, outside = keys.where("listed"), keys.where("not listed")
    n = inside.count()
    while n:
        level = len(made.words) + 1
        words = max(1, -(-BITS_PER_KEY * n // (64 * made.shards)))
        encoded = written(_encode(inside, level, made.shards, words), "level")
        made.words.append(words)
        made.filters = encoded if level == 1 else made.filters.join(encoded, "shard")
        wrong = written(outside.join(encoded, "shard").where(_passes(F.col(f"level_{level}"), F.col("key"), level, words)).select("key", "listed", "shard"), "wrong")
        inside, outside, n = wrong, inside, wrong.count()
    if made.filters is not None:
        made.filters = written(made.filters, "cascade")
    return made


def _rule(rules: tuple[tuple[str, str, str], ...], pick: int | None) -> Column:
    """Of the longest rule that fits, its name (pick None) or its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == r[0]) | F.col("host").endswith("." + r[0])) & F.col("path").startswith(r[1])
        out = F.when(fits, F.lit(r[0] + r[1] if pick is None else r[pick])).otherwise(out)
    return out


def page_key(url: Column) -> Column:
    """Host and path: what the list holds."""
    return F.concat(host(url), path(url))


def site_keys(pages: DataFrame, sites: tuple[str, ...] = SITES, url: str = "url") -> DataFrame:
    """(key): those of all pages whose host has a label of ``sites``; a list in production."""
    labels = F.split(host(F.col(url)), r"\.")
    return pages.where(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in sites]))).select(page_key(F.col(url)).alias("key")).distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page.

    ``listed`` (key): the list, of any size; keys of no page, repeated and null ones are of no effect. A page takes the
    verdict of the longest rule that fits, else ``block`` if the cascade holds its host and path, else ``allow``. A null url
    or one without ``://`` has an empty host and path, which no rule fits. Equal urls have equal verdicts; repeated rows stay;
    an empty table gives no rows, an empty list blocks nothing; other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    name = F.concat("host", "path")
    marked = rows.select(name.alias("key"), F.lit(0).alias("l"), F.lit(1).alias("p")).union(listed.select("key", F.lit(1), F.lit(0)))
    universe = marked.groupBy("key").agg((F.max("l") == 1).alias("listed"), F.max("p").alias("p")).where("p = 1").select("key", "listed")
    met = build(universe).member(rows, name, "held")
    verdict = F.coalesce(_rule(rules, 2), F.when(F.col("held"), "block").otherwise("allow"))
    return met.select("page_id", "host", "path", _rule(rules, None).alias("rule"), verdict.alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, site_keys(pages))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLE = {
    "op3_url_filter": f"""
    WITH parsed AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (
        SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed),
    listed AS (SELECT DISTINCT host || path AS k FROM parsed WHERE list_has_any(string_split(host, '.'), {list(SITES)}))
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
        WHEN host || path IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled"""
}
