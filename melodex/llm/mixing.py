"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's weight is its share of the tokens to the power of an exponent from 0 (all alike) to 1 (as they are). The
exponent is found by bisection: the largest that gives the wished entropy, raised as far as the limit on repetition asks.
Without a given budget the largest source is shown once, and t ** (exponent - 1) times one with the share t of its tokens.
The token budget then gives each source whole passes over its documents and a part of one more. A pass is a permutation of
the source's blocks and of the documents in each block by hashes; the part is the front of its last permutation, so that
only the one block in which the budget ends is cut. The end is found in three steps, by ranges of the blocks' hashes, by the
blocks of one range, by the documents of one block: no window holds more than one of these. What is decided is a row for each
source. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Halvings of the exponent's range in each job, and jobs.
HALVINGS, ROUNDS = 6, 5
#: A table of up to so many sources is broadcast; beyond, documents meet their source in a shuffle.
BROADCAST_SOURCES = 100_000
#: Leading hexadecimal digits of a block's hash that make its range: 16**3 ranges for each source.
RANGE_DIGITS = 3


@dataclass(frozen=True)
class Settings:
    """``entropy``: wished entropy of the weights, as a share of the largest possible. ``repeats``: most passes over any
    source. ``budget``: tokens to give out; None for the least that shows every document once. ``block_tokens``: the
    mean size of a source's blocks."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: int | None = None
    block_tokens: int = 20_000
    seed: int = 42


def tokens(text: Column) -> Column:
    """Words between white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source, told apart from a null one."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _order(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def exponent(sources: DataFrame, s: Settings = Settings()) -> float:
    """By bisection over ``sources`` (src, tokens): each job sums what 2**HALVINGS - 1 exponents give, six halvings at once."""
    least, most, n = sources.agg(F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if n < 2:
        return 1.0
    wished, cuts = s.entropy * math.log(n), 1 << HALVINGS

    def search(right: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            tried = [lo + (hi - lo) * i / cuts for i in range(1, cuts)]
            t = F.col("tokens") / most
            rows = sources.select("tokens", F.explode(F.array(*[F.lit(a) for a in tried])).alias("a")).groupBy("a").agg(F.sum(F.pow(t, "a")).alias("z"), F.sum(F.pow(t, "a") * F.log(t)).alias("zl"), F.max(F.pow(t, F.col("a") - 1)).alias("r"))
            at = {r["a"]: r for r in rows.collect()}  # 2**HALVINGS - 1 rows
            if right:  # the passes of the most repeated source, at most the limit: falls with the exponent
                fits = [a for a in tried if at[a]["r"] / at[a]["z"] * s.budget / most <= s.repeats]
                hi = min([hi, *fits])
                lo = max([lo, *(a for a in tried if a < hi)])
            else:  # entropy at least as wished: falls with the exponent
                fits = [a for a in tried if math.log(at[a]["z"]) - a * at[a]["zl"] / at[a]["z"] >= wished]
                lo = max([lo, *fits])
                hi = min([hi, *(a for a in tried if a > lo)])
        return hi if right else lo

    if s.budget is not None:
        return max(search(False), search(True))
    bound = 1 - math.log(s.repeats) / math.log(most / least) if most > least else 0.0
    return max(search(False), min(1.0, bound))


def _broadcast(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_SOURCES else rows


def _crossed(rows: DataFrame, by: list[str], room: str, out: str) -> DataFrame:
    """Of each source's ``rows`` (src, *by, n_tokens, room) in the order of ``by`` the first whose running sum is over the
    room; ``out``: the room that is left for it."""
    front = Window.partitionBy("src").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = rows.withColumn("through", F.sum("n_tokens").over(front)).where(F.col("through") > F.col(room))
    first = over.groupBy("src").agg(F.min_by(F.struct(*by, (F.col(room) - F.col("through") + F.col("n_tokens")).alias(out)), F.struct("through", *by)).alias("x"))
    return first.select("src", *[F.col(f"x.{c}").alias(c) for c in (*by, out)])


def decide(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(src, tokens, weight, blocks, passes, cut_order, cut_block, cut_rank) of ``rows`` (id as text, src, n_tokens).

    passes: whole ones. The last, partial one takes the blocks before (cut_order, cut_block), and of that one the documents
    whose rank is at most cut_rank (null: none). All null: no partial pass.
    """
    per = written(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens")), "sources")
    counted = per.where("tokens > 0")
    a = exponent(counted, s) if not counted.isEmpty() else 1.0
    most = counted.agg(F.max("tokens")).first()[0] or 0
    power = F.pow(F.col("tokens") / max(most, 1), F.lit(a))
    z = counted.agg(F.sum(power)).first()[0] or 1.0
    weighed = per.withColumn("weight", F.when(F.col("tokens") > 0, power / z).otherwise(0.0)).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / s.block_tokens)))
    budget = s.budget if s.budget is not None else weighed.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    share = F.col("weight") * F.lit(float(budget)) / F.col("tokens")
    passes = F.when(F.col("tokens") > 0, F.floor(share + 1e-9)).otherwise(1)
    rest = F.when(F.col("tokens") > 0, F.greatest(F.lit(0.0), F.floor((share - F.col("passes")) * F.col("tokens") + 1e-6))).otherwise(0.0)
    sources = written(weighed.withColumn("passes", passes.cast("int")).withColumn("rest", rest), "weights")
    partial = sources.where("rest > 0").select("src", "blocks", "passes", "rest")
    dealt = rows.join(_broadcast(partial), "src").withColumn("block", block(F.col("id"), F.col("blocks"), s))
    dealt = dealt.withColumn("order", order(F.col("src"), F.col("block"), F.col("passes"), s)).withColumn("range", F.substring("order", 1, RANGE_DIGITS))
    ranges = dealt.groupBy("src", "rest", "range").agg(F.sum("n_tokens").alias("n_tokens"))
    at_range = _broadcast(written(_crossed(ranges, ["range"], "rest", "room"), "ranges"))
    blocks = dealt.join(at_range, ["src", "range"]).groupBy("src", "room", "order", "block").agg(F.sum("n_tokens").alias("n_tokens"))
    at_block = written(_crossed(blocks, ["order", "block"], "room", "left"), "cuts")
    ranks = dealt.join(_broadcast(at_block.where("left > 0")), ["src", "order", "block"]).groupBy("src", "left", rank(F.col("id"), F.col("passes"), s).alias("rank")).agg(F.sum("n_tokens").alias("n_tokens"))
    inner = Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = ranks.withColumn("through", F.sum("n_tokens").over(inner)).where(F.col("through") <= F.col("left")).groupBy("src").agg(F.max("rank").alias("cut_rank"))
    cuts = at_block.select("src", F.col("order").alias("cut_order"), F.col("block").alias("cut_block")).join(last, "src", "left")
    full = F.when((F.col("rest") > 0) & F.col("cut_order").isNull(), 1).otherwise(0)  # the rest takes all blocks
    return written(sources.join(cuts, "src", "left").select("src", "tokens", "weight", "blocks", (F.col("passes") + full).alias("passes"), "cut_order", "cut_block", "cut_rank"), "decisions")


def order(src: Column, block_: Column, pass_: Column, s: Settings) -> Column:
    """Where a block stands in its source in a pass."""
    return _order("block", s.seed, pass_, src, block_)


def block(id_: Column, blocks: Column, s: Settings) -> Column:
    """The block of a document in its source, 0 to blocks - 1."""
    return F.pmod(F.conv(F.substring(_order("deal", s.seed, id_), 1, 12), 16, 10).cast("long"), blocks.cast("long"))


def rank(id_: Column, pass_: Column, s: Settings) -> Column:
    """Where a document stands in its block in a pass; documents of one id stand together."""
    return _order("document", s.seed, pass_, id_)


def mix(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of ``docs``, then ``_src``, ``_block``, ``_pass``, ``_rank``: a row for each pass in which a document stands.
    Where ``docs`` has a column of such a name, the new one has more underscores in front.

    The order of a source's stream: by _pass, then by the hash of the block, then by _rank. Documents without a word are in
    one pass of a source that has no tokens, else they go with their block. A null source is one of its own; a null id is
    the empty text; repeated ids of a source stand together. An empty table gives no rows.
    """
    s = settings
    src, block_, pass_, rank_ = fresh(docs, "_src", "_block", "_pass", "_rank")
    id_ = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = written(docs.select(id_.alias("id"), source_key(F.col(source)).alias("src"), tokens(F.col(text)).alias("n_tokens")), "lengths")
    decided = decide(rows, s)
    names = dict(zip(decided.columns, fresh(docs, *decided.columns), strict=True))
    got = lambda x: F.col(names[x])
    full = docs.join(_broadcast(decided.withColumnsRenamed(names)), source_key(F.col(source)) == got("src"))
    full = full.select(*docs.columns, got("src").alias(src), block(id_, got("blocks"), s).alias(block_), *[got(x) for x in ("passes", "cut_order", "cut_block", "cut_rank")])
    place, cut = F.struct(order(F.col(src), F.col(block_), got("passes"), s), F.col(block_)), F.struct(got("cut_order"), got("cut_block"))
    more = (place < cut) | (place == cut) & (rank(id_, got("passes"), s) <= got("cut_rank"))
    n = got("passes") + F.when(got("cut_order").isNotNull() & more, 1).otherwise(0)
    full = full.where(n > 0).withColumn(pass_, F.explode(F.sequence(F.lit(0), n - 1)))
    return full.select(*docs.columns, src, block_, pass_, rank(id_, F.col(pass_), s).alias(rank_))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, pass, block, rank, n_tokens): the mixed stream, a row for each document in each pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("_pass").alias("pass"), F.col("_block").alias("block"), F.col("_rank").alias("rank"), tokens(F.col("text")).alias("n_tokens"))


QUERIES = {"op5_mixing": op5_mixing}
ORACLE = {
    "op5_mixing": """
    WITH RECURSIVE d AS (
        SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') AS id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents),
    per AS (SELECT src, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY src),
    corpus AS (SELECT max(tokens) AS most, list(tokens / (SELECT max(tokens) FROM per)) AS t, ln(count(*)) * 0.95 AS wished FROM per WHERE tokens > 0),
    by_entropy AS (  -- the largest exponent with the wished entropy
        SELECT 0 AS step, 0.0::DOUBLE AS low
        UNION ALL
        SELECT step + 1, CASE WHEN ln(list_sum(list_transform(t, lambda x: pow(x, low + pow(0.5, step + 1))))) - (low + pow(0.5, step + 1))
            * list_sum(list_transform(t, lambda x: pow(x, low + pow(0.5, step + 1)) * ln(x))) / list_sum(list_transform(t, lambda x: pow(x, low + pow(0.5, step + 1)))) >= wished
            THEN low + pow(0.5, step + 1) ELSE low END
        FROM by_entropy, corpus WHERE step < 30),
    by_repeats AS (  -- the least exponent with at most four passes over the smallest source, the largest being shown once
        SELECT CASE WHEN max(tokens) > min(tokens) THEN least(1, 1 - ln(4) / ln(max(tokens) / min(tokens))) ELSE 0 END AS high FROM per WHERE tokens > 0),
    chosen AS (
        SELECT *, CASE WHEN len(t) < 2 THEN 1.0 ELSE greatest((SELECT low FROM by_entropy WHERE step = 30), (SELECT high FROM by_repeats)) END AS a FROM corpus),
    weighed AS (
        SELECT src, tokens, CASE WHEN tokens > 0 THEN pow(tokens / most, a) / list_sum(list_transform(t, lambda x: pow(x, a))) ELSE 0 END AS weight,
            greatest(1, ceil(coalesce(tokens / 20000, 0)))::BIGINT AS blocks FROM per LEFT JOIN chosen ON true),
    shared AS (SELECT *, weight * max(tokens / nullif(weight, 0)) OVER () / nullif(tokens, 0) AS share FROM weighed),
    passed AS (SELECT *, coalesce(floor(share + 1e-9), 1)::BIGINT AS passes FROM shared),
    sources AS (SELECT *, coalesce(greatest(0, floor((share - passes) * tokens + 1e-6)), 0) AS rest FROM passed),
    dealt AS (
        SELECT d.*, passes, rest, ('0x' || substr(md5('deal|42|' || id), 1, 12))::BIGINT % blocks AS block, md5('document|42|' || passes || '|' || id) AS last_rank
        FROM d JOIN sources USING (src)),
    sums AS (SELECT src, block, passes, rest, sum(n_tokens) AS held FROM dealt GROUP BY ALL),
    rooms AS (
        SELECT src, block, held, rest, rest + held - sum(held) OVER (PARTITION BY src ORDER BY md5('block|42|' || passes || '|' || src || '|' || block), block) AS room FROM sums),
    through AS (
        SELECT src, block, last_rank, room, sum(n_tokens) OVER (PARTITION BY src, block ORDER BY last_rank) AS through
        FROM dealt JOIN rooms USING (src, block) WHERE room > 0 AND room < held),
    lasts AS (SELECT src, block, max(last_rank) AS last FROM through WHERE through <= room GROUP BY src, block),
    timed AS (
        SELECT x.*, x.passes + CASE WHEN (r.room >= r.held AND r.rest > 0) OR last_rank <= last THEN 1 ELSE 0 END AS times
        FROM dealt x JOIN rooms r USING (src, block) LEFT JOIN lasts USING (src, block))
    SELECT doc_id, source, pass::INT AS pass, block, md5('document|42|' || pass || '|' || id) AS rank, n_tokens
    FROM (SELECT *, unnest(range(times)) AS pass FROM timed)"""
}
