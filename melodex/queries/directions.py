"""Rising and falling patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import directions as D
from ..operators import ngrams as G
from ..operators import phrases as P
from ..sources import adapters as S
from .language import tokens
from .registry import Registry
from .scalar import LABEL_LIST
from .sequences import NO, N, PH, phrases

R = Registry()
LETTER = "['S', 'r', 'R', 'g', 'G', 'm', 'M', 'P', 'd', 'D', 'n', 'N']"
NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
BITS = lambda x: "[CASE WHEN " + x + " THEN 1 ELSE 0 END FOR i IN range(12)]"
PAT = f"""raw AS (
    SELECT p_partkey AS place, p_brand || ' ' || (p_size % 3) AS name,
        array_to_string([({LETTER})[i + 1] FOR i IN range(12) IF ((p_partkey * 7919) >> i) & 1 = 1], '-') AS up_text,
        array_to_string([({LETTER})[i + 1] FOR i IN range(12) IF ((p_partkey * 104729) >> i) & 1 = 1], '') AS down_text FROM part),
pat AS (
    SELECT {NORMAL.format('name')} AS key, *, {BITS("((place * 7919) >> i) & 1 = 1")} AS up, {BITS("((place * 104729) >> i) & 1 = 1")} AS down
    FROM raw QUALIFY row_number() OVER (PARTITION BY {NORMAL.format('name')} ORDER BY place) = 1)"""


def table(spark, d):
    """Parts as a table of patterns: many rows of each name, the letters by the bits of the key."""
    letters = F.array(*[F.lit(x[0]) for x in D.LETTERS])
    bits = lambda m: F.filter(letters, lambda x, i: F.floor(F.col("p_partkey") * m / F.pow(F.lit(2), i)) % 2 == 1)
    name = F.concat_ws(" ", "p_brand", (F.col("p_size") % 3).cast("string"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("row"), name.alias("name"), F.array_join(bits(7919), "-").alias("up"), F.array_join(bits(104729), "").alias("down"))


def known(spark, d):
    return D.patterns(table(spark, d), "name", "up", "down", "row")


def flags(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "")


@R("direction_patterns", f"WITH {PAT} SELECT key, name, place, up_text, down_text, array_to_string(up, '') AS up, array_to_string(down, '') AS down FROM pat")
def direction_patterns(spark, d):
    return known(spark, d).withColumns({"up": flags("up"), "down": flags("down")})


@R("aligned_patterns", f"""{S.with_('scales')}, {PAT},
    names AS (SELECT scale_id * 2 AS place, name FROM scales UNION ALL SELECT scale_id * 2 + 1, upper(name) || ' (again)' FROM scales),
    first AS (
        SELECT *, {NORMAL.format("replace(name, ' (again)', '')")} AS key FROM names QUALIFY row_number() OVER (PARTITION BY {NORMAL.format("replace(name, ' (again)', '')")} ORDER BY place) = 1)
    SELECT first.name, pat.name AS source, up_text, down_text, first.place FROM first JOIN pat USING (key)""")
def aligned_patterns(spark, d):
    """Names of scales, each written in two ways, with the patterns of the same name."""
    s = S.scales(spark, d)
    names = s.select((F.col("scale_id") * 2).cast("long").alias("place"), "name").unionByName(s.select((F.col("scale_id") * 2 + 1).cast("long").alias("place"), F.concat(F.upper("name"), F.lit(" (again)")).alias("name")))
    return D.aligned(names, known(spark, d))


@R("pattern_lookup", f"""WITH {PAT},
    w AS (SELECT DISTINCT p_brand AS names FROM part UNION SELECT DISTINCT p_type || ',' || upper(p_brand) || ' 1' FROM part UNION SELECT DISTINCT p_type FROM part),
    e AS (SELECT names, u.nth, {NORMAL.format("trim(split_part(names, ',', u.nth))")} AS one FROM w, (SELECT unnest([1, 2]) AS nth) u WHERE u.nth <= len(string_split(names, ','))),
    x AS (SELECT names, arg_min(key, nth) AS key FROM e JOIN pat ON one = key GROUP BY 1),
    l AS (SELECT names, arg_min(key, (nth, place)) AS key FROM e JOIN pat ON contains(one, key) OR contains(key, one) WHERE one <> '' GROUP BY 1)
    SELECT names, coalesce(x.key, l.key) AS key, CASE WHEN x.key IS NOT NULL THEN 'exact' WHEN l.key IS NOT NULL THEN 'contains' ELSE 'none' END AS how
    FROM w LEFT JOIN x USING (names) LEFT JOIN l USING (names)""")
def pattern_lookup(spark, d):
    p = S.table(spark, d, "part")
    both = F.concat("p_type", F.lit(","), F.upper("p_brand"), F.lit(" 1"))
    wanted = p.select(F.col("p_brand").alias("names")).union(p.select(both)).union(p.select("p_type")).distinct()
    return D.pattern_for(wanted, known(spark, d))


@R("edge_conformance", f"""{NO}, {PH}, {PAT}, np AS (SELECT count(*) AS k FROM pat), pn AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i FROM pat),
    x AS (SELECT *, round_even(midi, 0) AS m, lag(round_even(midi, 0)) OVER (PARTITION BY recording_id, phrase ORDER BY start_us, note_id) AS b FROM ph),
    e AS (SELECT recording_id, pc, count(*) FILTER (m > b) AS u, count(*) FILTER (m < b) AS w FROM x WHERE b <> m GROUP BY 1, 2),
    own AS (SELECT r.recording_id, key, up, down FROM (SELECT DISTINCT recording_id FROM notes) r, np JOIN pn ON pn.i = r.recording_id % np.k),
    t AS (
        SELECT own.recording_id, key, pc.pc, up[pc.pc + 1] > 0 AS wu, down[pc.pc + 1] > 0 AS wd, coalesce(u, 0) > 0 AS iu, coalesce(w, 0) > 0 AS id, coalesce(u, 0) + coalesce(w, 0) >= 3 AS enough
        FROM own CROSS JOIN (SELECT unnest(range(12)) AS pc) pc LEFT JOIN e ON e.recording_id = own.recording_id AND e.pc = pc.pc),
    g AS (
        SELECT recording_id, key, count(*) FILTER (enough) AS notes, sum(CASE WHEN enough THEN (iu = wu)::INT + (id = wd)::INT ELSE 0 END)::BIGINT AS matched,
            {", ".join(f"coalesce(array_to_string(list(({LABEL_LIST})[pc + 1] ORDER BY pc) FILTER (enough AND {c}), ','), '') AS {n}" for n, c in
                       (("missing_up", "wu AND NOT iu"), ("missing_down", "wd AND NOT id"), ("unexpected_up", "NOT wu AND iu"), ("unexpected_down", "NOT wd AND id")))}
        FROM t GROUP BY 1, 2)
    SELECT *, 2 * notes AS total, round(CASE WHEN notes > 0 THEN matched / (2 * notes) ELSE 0 END, 3) AS score FROM g""")
def edge_conformance(spark, d):
    """How far recordings keep to a pattern each, dealt to them by their number."""
    from pyspark.sql import Window

    k = known(spark, d)
    dealt = k.withColumn("i", F.row_number().over(Window.orderBy("key")) - 1).select("i", "key", "up", "down")
    size = k.count()
    rec = S.notes(spark, d).select("recording_id").distinct().withColumn("i", (F.col("recording_id") % size).cast("int"))
    own = rec.join(F.broadcast(dealt) if size <= D.BROADCAST_PATTERNS else dealt, "i").drop("i")
    return D.conformance(D.edges(phrases(spark, d), ["phrase"]), own).join(own.select("recording_id", "key"), "recording_id")


@R("pattern_summary", f"""{NO}, {PH}, a AS (SELECT *, round_even(midi, 0) AS p FROM notes), b AS (SELECT *, lag(p) OVER ({N}) AS before FROM a),
    c AS (SELECT *, CAST(sign(p - before) AS INT) AS direction FROM b WHERE before IS NULL OR before <> p),
    e AS (SELECT *, sum(CASE WHEN direction <> ld THEN 1 ELSE 0 END) OVER ({N}) AS run FROM (SELECT *, lag(direction) OVER ({N}) AS ld FROM c)),
    l AS (SELECT *, arg_min(before, (start_us, note_id)) OVER (PARTITION BY recording_id, run) AS f FROM e WHERE direction IS NOT NULL),
    lab AS (SELECT i, ({LABEL_LIST})[CAST((i % 12 + 12) % 12 AS INT) + 1] || CASE WHEN i < 48 THEN repeat(chr(39), CAST(-floor((i - 48) / 12) AS INT)) ELSE repeat(chr(183), CAST(floor((i - 48) / 12) AS INT)) END AS label FROM (SELECT unnest(range(-200, 300)) AS i)),
    r AS (
        SELECT recording_id, run, any_value(direction) AS direction, any_value(x.label) || ' ' || string_agg(y.label, ' ' ORDER BY start_us, note_id) AS pattern
        FROM l JOIN lab x ON x.i = l.f JOIN lab y ON y.i = l.p GROUP BY 1, 2),
    w AS (SELECT track, lead(track, 1) OVER q AS t1, lead(track, 2) OVER q AS t2, lead(track, 3) OVER q AS t3, lead(track, 4) OVER q AS t4 FROM ph WINDOW q AS (PARTITION BY recording_id, phrase ORDER BY start_us, note_id)),
    wd AS (SELECT [x FOR x IN [track, t1, t2, t3, t4] IF x IS NOT NULL] AS w FROM w WHERE t2 IS NOT NULL),
    sub AS (SELECT array_to_string(w[a:a + n - 1], '|') AS pattern FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS a FROM wd, (SELECT unnest([3, 4, 5]) AS n))),
    k AS (
        SELECT CASE direction WHEN 1 THEN 'up' ELSE 'down' END AS kind, pattern, count(*) AS n FROM r GROUP BY 1, 2
        UNION ALL SELECT 'motif', pattern, count(*) FROM sub GROUP BY 2 HAVING count(*) >= 2)
    SELECT kind, pattern, n, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, pattern) AS place FROM k)
    WHERE place <= CASE kind WHEN 'motif' THEN 10 ELSE 5 END""")
def pattern_summary(spark, d):
    """The five commonest rising and falling runs, as labels, and the ten commonest motifs."""
    tonic = F.lit(0)
    runs = P.monotone_runs(S.notes(spark, d), E.half_even("midi"))
    text = F.concat_ws(" ", E.label("first", tonic), F.transform("rest", lambda x: E.label(x, tonic)))
    runs = runs.groupBy(F.when(F.col("direction") == 1, "up").otherwise("down").alias("kind"), text.alias("pattern")).agg(F.count("*").alias("n"))
    w = S.note_order("seq")
    near = tokens(spark, d).select("track", *[F.lead("track", k).over(w).alias(f"_{k}") for k in range(1, 5)]).where("_2 is not null")
    near = near.select(F.array_compact(F.array("track", "_1", "_2", "_3", "_4")).alias("tokens"))
    motifs = G.ngrams(near, 3, 5).groupBy(F.lit("motif").alias("kind"), F.col("ngram").alias("pattern")).agg(F.count("*").alias("n")).where("n >= 2")
    return D.summary(runs.unionByName(motifs), {"up": 5, "down": 5, "motif": 10})


QUERIES, ORACLE = R.queries, R.oracle
