"""Names: containment through an index of q-grams, and a chain of spellings from the closest to the loosest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(text: str, sizes: str) -> Column:
    """The distinct pieces of a text of the sizes of an SQL array."""
    return F.expr(f"array_distinct(flatten(transform({sizes}, n -> transform(sequence(1, length({text}) - n + 1), i -> substring({text}, i, n)))))")


def contained(holders: DataFrame, parts: DataFrame, holder: str, part: str, q: int = 4) -> DataFrame:
    """(holder, part): all pairs of distinct texts in which the part stands in the holder. Null and empty texts are in none.

    Holders are indexed by all their pieces of 1 to q letters. A part asks by one piece only, of q letters or all it has, that
    which the fewest holders have; what meets is verified. No nested loop.
    """
    texts = holders.select(F.col(holder)).where(F.length(holder) > 0).distinct()
    index = texts.select(holder, F.explode(_grams(holder, f"sequence(1, least({q}, length({holder})))")).alias("_g"))
    have = index.groupBy("_g").agg(F.count("*").alias("_n"))
    pieces = parts.select(F.col(part)).where(F.length(part) > 0).distinct()
    asked = pieces.select(part, F.explode(_grams(part, f"array(least({q}, length({part})))")).alias("_g")).join(have, "_g", "left")
    rarest = asked.groupBy(part).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r"))
    rarest = rarest.where("_r.n > 0").select(part, F.col("_r.g").alias("_g"))
    return rarest.join(index, "_g").where(F.col(holder).contains(F.col(part))).select(holder, part)


def alike(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): all pairs of distinct texts of which one stands in the other."""
    return contained(left, right, a, b).select(a, b).union(contained(right, left, b, a).select(a, b)).distinct()


#: Stages from the closest to the loosest; those of a suffix come in the order of the suffixes.
STAGES = ("exact", "case", "i_to_ee", "ee_to_i", "ti_to_hoti", "hoti_to_ti", "variant_case", "suffix", "suffix_case", "contains")


def spelling_chain(wanted: DataFrame, known: DataFrame, suffixes: list[str], name: str = "name", found: str = "found", order: str = "place", least: int = 4) -> DataFrame:
    """(name, found, stage): each distinct name with the known one of the closest stage, there the first by ``order``; null if none.

    A spelling is met strictly if it is a known name or one in lower case. Stages: the name strictly; but for case; its
    spellings (all i as ee, all ee as i, a last ti as hoti, a last hoti as ti) strictly in this order, then any of them but for
    case; without a suffix, strictly or but for case, suffixes in order; the first known name of ``least`` letters or more that
    stands in it, but for case. All spellings of all names meet the known ones in one equi-join; only what is left over asks the
    index of pieces. Null and empty names find nothing.
    """
    names = wanted.select(name).where(F.length(name) > 0).distinct()
    n = F.col(name)
    spelled = [
        ("i_to_ee", F.when(n.contains("i"), F.replace(n, F.lit("i"), F.lit("ee")))),
        ("ee_to_i", F.when(n.contains("ee"), F.replace(n, F.lit("ee"), F.lit("i")))),
        ("ti_to_hoti", F.when(n.endswith("ti"), F.concat(F.expr(f"substring({name}, 1, length({name}) - 2)"), F.lit("hoti")))),
        ("hoti_to_ti", F.when(n.endswith("hoti"), F.concat(F.expr(f"substring({name}, 1, length({name}) - 4)"), F.lit("ti")))),
    ]
    ways = [("exact", n, True), ("case", n, False), *[(k, x, True) for k, x in spelled], *[("variant_case", x, False) for _, x in spelled]]
    for s in suffixes:
        base = F.when(n.endswith(s), F.trim(F.expr(f"substring({name}, 1, length({name}) - {len(s)})")))
        ways += [("suffix", base, True), ("suffix_case", base, False)]
    listed = F.array(*[F.struct(F.lit(i).alias("way"), F.lit(k).alias("stage"), x.alias("text"), F.lit(strict).alias("strict")) for i, (k, x, strict) in enumerate(ways)])
    each = names.select(name, F.inline(listed)).where(F.length("text") > 0)
    k = known.select(F.col(found).alias("_known"), F.col(order).alias("_order")).where(F.length("_known") > 0)
    met = each.join(k, F.lower("text") == F.lower("_known"))
    fits = ~F.col("strict") | (F.col("text") == F.col("_known")) | (F.col("text") == F.lower("_known"))
    best = met.where(fits).groupBy(name).agg(F.min(F.struct("way", "_order", "_known", "stage")).alias("b")).select(name, F.col("b._known").alias(found), F.col("b.stage").alias("stage"))
    rest = names.join(best, name, "left_anti").withColumn("_low", F.lower(name))
    low = k.withColumn("_part", F.lower("_known")).where(F.length("_part") >= least)
    inside = contained(rest, low, "_low", "_part").join(rest, "_low").join(low, "_part")
    loose = inside.groupBy(name).agg(F.min_by("_known", F.struct("_order", "_known")).alias(found)).withColumn("stage", F.lit("contains"))
    out = best.unionByName(loose)
    return names.join(out, name, "left")
