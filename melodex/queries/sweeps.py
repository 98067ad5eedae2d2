"""Sweeps of bands, weights and gates over all recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as O
from ..operators import sweeps as W
from ..sources import adapters as S
from .registry import Registry
from .scoring import SC, SCORED, scored

R = Registry()
LOW, HIGH, STEP, FIXED, WEIGHTS = 50, 500, 50, 8.0, (0.0, 1.0, 2.0, 5.0, 20.0)
EDGES = list(range(LOW, HIGH + 1, STEP))
GATES = ("runtime", "half")
#: Tonics by the segment of the customer that a recording's user is: as voices and instruments have them.
ALLOWED = {"BUILDING": [1, 2, 3, 4, 5], "MACHINERY": [7, 8, 9, 10, 11], "HOUSEHOLD": [0, 11, 10, 9]}
_CASES = " ".join(f"WHEN '{k}' THEN {sorted(v)}" for k, v in ALLOWED.items())
SWEPT = f"""{SC}, {SCORED},
    vm AS (SELECT recording_id, pitch_hz, confidence, 69 + 12 * log2(pitch_hz / 440) AS midi FROM frames WHERE voicing AND pitch_hz > 0),
    fit12 AS (SELECT recording_id, tonic, round(max(round(fit, 6)), 6) AS fit FROM fitted GROUP BY 1, 2),
    whom AS (
        SELECT recording_id, recording_id % 12 AS tonic, CASE c_mktsegment {_CASES} ELSE range(12) END AS allowed
        FROM (SELECT DISTINCT user_id AS recording_id FROM events) LEFT JOIN customer ON c_custkey = recording_id),
    sets AS (
        SELECT lo, hi, {FIXED}::DOUBLE AS weight FROM (SELECT unnest(range({LOW}, {HIGH}, {STEP})) AS lo), (SELECT unnest(range({LOW}, {HIGH + 1}, {STEP})) AS hi)
        WHERE hi > lo
        UNION SELECT 100, 300, unnest({list(WEIGHTS)})),
    cell AS (SELECT unnest(range(12)) AS pc),
    gated AS (
        SELECT recording_id, 'runtime' AS gate, pitch_hz, ((CAST(round_even(midi, 0) AS INT) % 12) + 12) % 12 AS pc FROM vm WHERE confidence >= 0.3
        UNION ALL SELECT recording_id, 'half', pitch_hz, ((CAST(round_even(midi, 0) AS INT) % 12) + 12) % 12 FROM vm WHERE confidence > 0.5),
    hist AS (SELECT recording_id, gate, lo, hi, pc, count(*) AS n FROM gated JOIN (SELECT DISTINCT lo, hi FROM sets) ON pitch_hz >= lo AND pitch_hz < hi GROUP BY ALL),
    full_ AS (
        SELECT w.recording_id, w.tonic, allowed, g.gate, s.lo, s.hi, s.weight, cell.pc, coalesce(n, 0) AS n, f.fit,
            max(coalesce(n, 0)) OVER (PARTITION BY w.recording_id, g.gate, s.lo, s.hi, s.weight) AS most
        FROM whom w CROSS JOIN (SELECT unnest(['runtime', 'half']) AS gate) g CROSS JOIN sets s CROSS JOIN cell
        LEFT JOIN hist h ON h.recording_id = w.recording_id AND h.gate = g.gate AND h.lo = s.lo AND h.hi = s.hi AND h.pc = cell.pc
        LEFT JOIN fit12 f ON f.recording_id = w.recording_id AND f.tonic = cell.pc),
    scored_ AS (
        SELECT *, round(coalesce(fit, -1000) + weight * n / greatest(most, 1), 9) AS both_, list_contains(allowed, pc) AS may FROM full_),
    picks AS (
        SELECT recording_id, gate, lo, hi, weight, tonic, max(n) > 0 AS heard,
            arg_max(pc, (n, -pc)) FILTER (n > 0) AS b1, arg_max(pc, (n, -pc)) FILTER (n > 0 AND may) AS b2,
            arg_max(pc, (fit, -pc)) FILTER (fit IS NOT NULL) AS h1, arg_max(pc, (fit, -pc)) FILTER (fit IS NOT NULL AND may) AS h2,
            arg_max(pc, (both_, -pc)) AS c1, arg_max(pc, (both_, -pc)) FILTER (may) AS c2
        FROM scored_ GROUP BY 1, 2, 3, 4, 5, 6),
    swept AS (
        SELECT gate, lo::INT AS lo, hi::INT AS hi, weight, count(*) AS total, count(*) FILTER (heard) AS band_frames,
            count(*) FILTER (b1 = tonic) AS band_only, count(*) FILTER (b2 = tonic) AS band_allowed, count(*) FILTER (h1 = tonic) AS hist_only,
            count(*) FILTER (h2 = tonic) AS hist_allowed, count(*) FILTER (c1 = tonic) AS combined_only, count(*) FILTER (c2 = tonic) AS combined_allowed
        FROM picks GROUP BY 1, 2, 3, 4)"""

def swept(spark, d):
    f = O.voiced(S.frames(spark, d))
    prefixes = W.band_prefixes(f, EDGES, {"runtime": F.col("confidence") >= 0.3, "half": F.col("confidence") > 0.5})
    fits = scored(spark, d).groupBy("recording_id", "tonic").agg(F.round(F.max("fit"), 6).alias("fit"))  # rounding keeps the order
    fits = fits.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("tonic").cast("int"), "fit"))).alias("m"))
    segment = S.table(spark, d, "customer").select(F.col("c_custkey").alias("recording_id"), "c_mktsegment")
    users = S.frames(spark, d).select("recording_id").distinct().join(segment, "recording_id", "left")
    allowed = F.sequence(F.lit(0), F.lit(11))
    for k, v in ALLOWED.items():
        allowed = F.when(F.col("c_mktsegment") == k, F.array(*map(F.lit, sorted(v)))).otherwise(allowed)
    twelve = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.try_element_at("m", i))
    whom = users.join(fits, "recording_id", "left").select("recording_id", (F.col("recording_id") % 12).cast("int").alias("tonic"), allowed.alias("allowed"), twelve.alias("fits"))
    settings = [(lo, hi, FIXED) for lo, hi in W.bands(LOW, HIGH, STEP, STEP)] + [(100, 300, w) for w in WEIGHTS]
    return W.sweep(whom, prefixes, EDGES, list(GATES), list(dict.fromkeys(settings)))


@R("band_weight_sweep", f"{SWEPT} SELECT * FROM swept")
def band_weight_sweep(spark, d):
    """Bands at one weight and weights at one band, by two gates: coverage and six counts of tonics found."""
    return swept(spark, d)


@R(
    "sweep_best_bands",
    f"""{SWEPT} SELECT *, row_number() OVER (PARTITION BY gate, weight ORDER BY combined_allowed DESC, band_allowed DESC, hi - lo, lo, hi) AS place
    FROM swept WHERE weight = {FIXED} QUALIFY place <= 5""",
)
def sweep_best_bands(spark, d):
    return W.best_bands(swept(spark, d).where(F.col("weight") == FIXED))


@R(
    "sweep_best_weight",
    f"""{SWEPT} SELECT * FROM swept WHERE lo = 100 AND hi = 300
    QUALIFY row_number() OVER (PARTITION BY gate ORDER BY combined_allowed DESC, weight) = 1""",
)
def sweep_best_weight(spark, d):
    return W.best_weight(swept(spark, d).where("lo = 100 and hi = 300"))


QUERIES, ORACLE = R.queries, R.oracle
