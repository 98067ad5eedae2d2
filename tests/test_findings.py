"""What the findings of a review named: each would have failed before it was mended."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from melodex import queries as Q
from melodex.operators import directions as D

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_patterns_are_dealt_alike_however_they_are_joined(spark, monkeypatch):
    """the bound up to which patterns are broadcast was missing."""
    found = rows(Q.QUERIES["edge_conformance"](spark, DATA))
    monkeypatch.setattr(D, "BROADCAST_PATTERNS", 0)
    assert found and rows(Q.QUERIES["edge_conformance"](spark, DATA)) == found


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events of which some have no pitch, alone in a phrase with another, and part keys beyond 100,000."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    values = "CASE WHEN event_id % 7 < 2 THEN 0 ELSE value END"
    con.execute(f"copy (select * replace ({values} as value) from '{DATA}/events.parquet') to '{folder}/events.parquet'")
    con.execute(f"copy (select * replace (CASE WHEN l_linenumber % 2 = 0 THEN 50003 ELSE 150003 END + l_partkey % 2 * 5 as l_partkey) from '{DATA}/lineitem.parquet') to '{folder}/lineitem.parquet'")
    for t in ("part", "orders"):
        con.execute(f"copy (select * from '{DATA}/{t}.parquet') to '{folder}/{t}.parquet'")
    return str(folder)


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["label_from_midi", "label_from_midi_events", "lm_token", "corrected_triple", "deletion_rate", "distinct_trigrams", "cluster_phrases", "edit_phrases", "edit_notes"])
def test_query_agrees_with_its_sql_on_odd_rows(spark, odd, name):
    """Notes without a pitch, and rows of one place."""
    con = duckdb.connect()
    for t in ("events", "lineitem", "part", "orders"):
        con.execute(f"create view {t} as select * from '{odd}/{t}.parquet'")
    ran = con.execute(Q.ORACLE[name])
    columns = [x[0] for x in ran.description]
    want = sorted((tuple(map(plain, r)) for r in ran.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in Q.QUERIES[name](spark, odd).select(*columns).collect()), key=str) == want


def test_samples_are_whole_to_the_digits_that_levels_have(spark):
    """a level rounded to nine digits made 24.9999996 of 25 samples, which fell to 24 or 25 by the order of sums."""
    from melodex.operators import histogram as H

    v = [0.0] * 100
    v[50], v[51], v[49] = 0.95, 0.0249999996, 0.0250000004
    got = H.gaussian_vector(spark.createDataFrame([(1, v, [50])], "recording_id long, smooth array<double>, peaks array<int>")).first()
    near = {i: max(1, 950 if i == 50 else 25 if i in (49, 51) else 1) for i in range(44, 57)}
    mu = sum(k * (i + 0.5) * 12 for i, k in near.items()) / sum(near.values())
    assert got["deviation"] == pytest.approx(mu - 606, abs=1e-6)


def test_sets_of_notes_meet_scales_as_numbers(spark):
    """intervals were worked out anew for each step of each rotation of each recording."""
    from melodex.operators import scoring as C

    masks = {1: [0, 4, 7], 2: [0, 3, 7], 3: [2, 6, 9], 4: [0], 5: [0, 6]}
    scales = spark.createDataFrame([(k, [int(i in v) for i in range(12)]) for k, v in masks.items()], "scale_id int, mask array<int>")
    sets = {1: [1, 5, 8], 2: [2, 5, 9, 11], 3: [3, 9], 4: [7], 5: []}
    found = C.by_intervals(spark.createDataFrame(list(sets.items()), "recording_id long, pcs array<int>"), scales)
    want = {(r, t, k) for r, pcs in sets.items() for t in pcs for k, v in masks.items() if len(v) > 1 and {(p - t) % 12 for p in pcs} == {x - v[0] for x in v}}
    assert {(x["recording_id"], x["tonic"], x["scale_id"]) for x in found.collect()} == want == {(1, 1, 1), (1, 1, 3), (3, 3, 5), (3, 9, 5)}
    assert "transform(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cells_go_to_python_as_numbers(spark):
    """An object for each cell of ten thousand recordings lay in a worker's memory at once."""
    from melodex.operators import histogram as H
    from melodex.sources import adapters as S

    df = H.profile(S.frames(spark, DATA)).select(H.count_peaks("cells").alias("n"))
    assert re.search(r"_count_noted\(cells#\d+\.cent, cells#\d+\.low, cells#\d+\.weight\)", str(df._jdf.queryExecution().optimizedPlan().toString()))


def test_paths_score_as_positions_do(spark):
    """each position of each recording met every class; now each distinct path does."""
    import random

    from melodex.operators import ngrams as G

    rng = random.Random(5)
    data = [(r, "xyz"[r % 3], s, i, rng.choice("abcd")) for r in range(12) for s in range(3) for i in range(rng.randrange(1, 9))]
    tokens = spark.createDataFrame(data, "recording_id long, class string, seq int, at int, token string")
    by = ["recording_id", "class", "seq"]
    grams, paths = G.windowed_ngrams(tokens, by, ["at"]), G.windowed_paths(tokens, by, ["at"])
    counted = G.counts(grams, ["class"])
    totals, own = counted.where("n = 1").groupBy("class").agg({"cnt": "sum"}).toDF("class", "tokens"), G.counts(grams, ["recording_id", "class"])
    more = (counted, totals, 5, 3, [0.2, 0.3, 0.5], 0.1)
    scored = G.score_paths(paths, *more)
    assert scored.count() == 3 * paths.select("path").distinct().count()
    found = lambda df, v: {(x["recording_id"], x["class"]): x[v] for x in df.collect()}
    plain = lambda own: found(G.score_sequences(G.score_positions(grams, *more, own)), "logprob")
    assert found(G.score_recordings(paths, scored), "logprob") == pytest.approx(plain(None))
    mine = G.own_paths(paths.groupBy("recording_id", "path").count().withColumnRenamed("count", "times"), counted, totals, own, *more[2:])
    assert found(G.score_recordings(paths, scored, mine), "logprob") == pytest.approx(plain(own))
    w = G.entropy_weights(counted).where("ngram != 'a'")
    got = G.score_recordings(paths, scored, weights=G.path_weights(paths, w)).selectExpr("recording_id", "class", "total / weight as mean")
    assert found(got, "mean") == pytest.approx(found(G.weighted_scores(grams, G.score_positions(grams, *more), w, 3), "mean"))


def test_skyline_sorts_distinct_firsts_only(spark):
    """three windows went over all rows, one of them sorted anew."""
    import random

    from melodex.operators import joins as J

    rng = random.Random(1)
    data = [(rng.randrange(6), rng.choice([None, 1.0, 2.0, 3.0]), rng.randrange(4) / 2, i) for i in range(200)]
    df = spark.createDataFrame(data, "g long, a double, b double, i int")
    over = lambda y, x: y[0] == x[0] and None not in (y[1], x[1]) and y[1] >= x[1] and y[2] >= x[2] and (y[1] > x[1] or y[2] > x[2])
    known = [x for x in data if x[1] is not None]
    found = J.skyline(df.where("a is not null"), ["g"], "a", "b")
    assert sorted(r["i"] for r in found.collect()) == [x[3] for x in known if not any(over(y, x) for y in known)]
    assert str(found._jdf.queryExecution().optimizedPlan().toString()).count("Window ") == 1


def test_gaussians_need_no_empty_bins(spark):
    """every recording met its empty bins, for each of twelve notes."""
    from melodex.operators import histogram as H
    from melodex.sources import adapters as S

    f = S.frames(spark, DATA)
    some, every = H.folded(f, 100, weighted=False, zeros=False), H.folded(f, 100, weighted=False)
    assert rows(some) == rows(every.where("count > 0"))
    at = some.select("recording_id").distinct().selectExpr("recording_id", "explode(array(0.0D, 700.0D)) as cent")
    assert [tuple(map(plain, r)) for r in rows(H.gaussian_at(some, at, 100))] == [tuple(map(plain, r)) for r in rows(H.gaussian_at(every, at, 100))]
    plan = Q.QUERIES["gmm_closed_form"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([0,1,2" not in str(plan) and "LeftOuter" not in str(plan)


@pytest.mark.parametrize("name", ["stationary_notes", "merge_small_phrases", "merge_notes", "snap_continuity", "command_analyse"])
def test_folds_walk_through_many_recordings_at_once(spark, name):
    """each recording, and each piece of one, was a group of its own, with a call and tables of its own."""
    found = Q.QUERIES[name](spark, DATA)
    plan = str(found._jdf.queryExecution().optimizedPlan().toString())
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    whole, size = rows(found), "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        assert rows(Q.QUERIES[name](spark, DATA)) == whole
    finally:
        spark.conf.set(size, kept)


def test_halves_of_rates_go_up(spark, tmp_path):
    """of 640 or 128 notes the share can end in a half at the seventh place, which fell as the last bit of a difference had it."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (CASE WHEN event_id < 640 THEN 1 ELSE event_id // 128 END as user_id) from '{DATA}/events.parquet' where event_id < 960) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(con.execute(f"select recording_id, rate, residual from ({Q.ORACLE['deletion_rate']})").fetchall())
    assert sorted(map(tuple, Q.QUERIES["deletion_rate"](spark, str(tmp_path)).select("recording_id", "rate", "residual").collect())) == want and len(want) > 2


def test_tables_hold_many_recordings(spark, tmp_path):
    """each recording had a folder and a file of its own, so files grew as recordings did."""
    from melodex.sources import files as C

    data = [(f"r {k}", i, str(i + k), "x") for k in range(300) for i in range(1 + k % 3)]
    df = spark.createDataFrame(data, "stem string, i long, start string, label string").repartition(7)
    C.write_csv(df.withColumn("midi", F.lit("60")), str(tmp_path), ["stem"], ["i"])
    assert len(list(tmp_path.rglob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = C.read_transcriptions(spark, str(tmp_path), "stem").select("stem", "row", "start").collect()
    assert sorted(map(tuple, got)) == sorted((k, i, float(t)) for k, i, t, _ in data)
    notes = C.read_motif_notes(spark, str(tmp_path), None, "stem").select("stem", "row", "start", "token").collect()
    assert sorted(map(tuple, notes)) == sorted((k, i, min(float(t), i + 1.0), "x:0") for k, i, t, _ in data)  # no end: that of the next row


def test_saturated_scores_are_worked_out_once(spark):
    """a filter carried the whole score, with all its sums for each use, down to the hypotheses, and rounded every one."""
    from melodex.operators import scoring as C

    raws = [1.0, 1.0000000004, 1.0000000006, -1.0000000006, 2.0, 0.5, None]
    df = spark.createDataFrame([(i, 1, 0, x, 0.0) for i, x in enumerate(raws)], "recording_id long, scale_id int, tonic int, fit_raw double, up double")
    assert [r["recording_id"] for r in C.saturated(df).orderBy("recording_id").collect()] == [2, 3, 4]
    plan = str(Q.QUERIES["saturated_candidates"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString())
    assert not [x for x in plan.splitlines() if ("Join" in x or "Filter" in x) and "round(" in x]


def test_valleys_meet_scales_as_numbers(spark):
    """F32: arrays of notes were gone through for each of hundreds of hypotheses of a recording."""
    import random

    from melodex.operators import scoring as C

    rng = random.Random(3)
    data = [(r, [1 / 12] * 12, [rng.randrange(5) for _ in range(12)], rng.randrange(8), [rng.random() < 0.6 for _ in range(12)]) for r in range(20)]
    found = spark.createDataFrame(data, "recording_id long, p array<double>, counts array<long>, n_peaks int, dips array<boolean>")
    masks = {1: [0, 2, 4, 5, 7, 9, 11], 2: [0, 11], 3: list(range(12))}
    scales = spark.createDataFrame([(k, [int(i in v) for i in range(12)]) for k, v in masks.items()], "scale_id int, mask array<int>")
    on = scales.select("scale_id", C.bits(lambda i: F.get("mask", F.lit(i)) == 1).alias("on"))
    got = C.valleys(C.hypotheses(C.low_notes(found), scales).join(on, "scale_id"))
    want = {}
    for r, _, counts, n, dips in data:
        tops = sorted(range(12), key=lambda i: (-counts[i], -i))[:n]
        low = {i for i in range(12) if dips[i] and i not in tops}
        want |= {(r, k, t): len(low & {(s + t) % 12 for s in v}) for k, v in masks.items() for t in range(12)}
    assert {(x["recording_id"], x["scale_id"], x["tonic"]): x["valley_penalty"] for x in got.collect()} == want
    plan = str(Q.QUERIES["candidate_valleys"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString())
    assert "array_contains" not in plan.split("Join Inner")[0]


def test_sweeps_multiply_no_recording_by_the_settings(spark):
    """each recording became a row for each setting, with arrays of twelve rounded scores, twice."""
    plan = str(Q.QUERIES["band_weight_sweep"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString())
    assert "MapInPandas" in plan and "Generate inline" not in plan.split("MapInPandas")[0] and plan.count("Generate inline") == 0
    from melodex.operators import sweeps as W

    people = spark.createDataFrame([(1, 3, [3, 4], None), (2, None, [1], [1.0] * 12), (3, 0, [], [None] * 12)], "recording_id long, tonic int, allowed array<int>, fits array<double>")
    none = spark.createDataFrame([], "recording_id long, gate string, prefixes array<array<long>>")
    got = [tuple(r) for r in W.sweep(people, none, [50, 100], ["a"], [(50, 100, 1.0)]).collect()]
    # without frames or fits all twelve tie: combined takes the lowest, of those allowed if any
    assert got == [("a", 50, 100, 1.0, 3, 0, 0, 0, 0, 0, 1, 1)]
    assert W.sweep(people.limit(0), none, [50, 100], ["a"], [(50, 100, 1.0)]).collect() == []


def test_tasks_write_and_list_files(spark, tmp_path):
    """the driver renamed each recording's folder, and listed and planned them all."""
    from melodex.sources import listing as L

    data = [(f"{k % 3}/Rec{k}/{name}", i, f"{k},{i}") for k in range(40) for name in ("a.csv", "more/b.csv")[: 1 + k % 2] for i in range(1 + k % 9)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # so that files go on from block to block
        L.write_files(spark.createDataFrame(data, "path string, i int, line string").repartition(5), f"file://{tmp_path}", ["i"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = {}
    for path, _, line in data:
        want[path] = want.get(path, "") + line + "\n"
    assert {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*") if f.is_file()} == want
    found = L.listed_below(spark, f"file://{tmp_path}", spark.range(5).selectExpr("cast(id as string) as folder")).collect()
    assert sorted((r["path"], r["bytes"]) for r in found) == sorted((f"file://{tmp_path}/{p}", len(t)) for p, t in want.items())
    assert all(r["modified"] is not None for r in found)


@pytest.mark.parametrize("most, least", [(60.0, 0.0), (60.0, 1.5), (15.0, 0.5), (1000.0, 0.0)])
def test_events_and_turns_are_those_of_the_join(spark, most, least):
    """events, turns and the join that holds them against each other went over the frames one by one."""
    from melodex.operators import frames as O
    from melodex.operators import joins as J
    from melodex.sources import adapters as S

    f = S.frames(spark, DATA)
    events = O.stationary_events(f, most, least).select("recording_id", "start", "end", "midi", "energy")
    turns = J.contained_anti(O.inflections(f), events, 5.0).selectExpr("recording_id", "t as start", "t as end", "midi", "energy")
    plain = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.select("recording_id", "start", "end", "midi", "energy").collect())
    found = plain(O.events_and_turns(f, most, least))
    assert found == plain(events.unionByName(turns)) and len(found) > 50


def test_silences_split_phrases_in_order_as_by_the_join(spark):
    """phrases met silences in a join, for which the notes were worked out twice."""
    import random

    from melodex.operators import phrases as P
    from melodex.sources.adapters import UNIT

    rng = random.Random(2)
    notes, quiet = [], []
    for r in [*range(1, 9), None]:
        t = rng.random()
        for i in range(40):
            e = t + rng.choice([0.0, 0.25, 1.0])
            notes.append((r, i, t, e, round(t * UNIT), round(e * UNIT)))
            t = e + rng.choice([0.0, 0.25, 0.5, 0.75, 3.0])
        for k in range(120):  # some overlap each other, or reach beyond their phrase
            a = rng.random() * t
            b = a + rng.random() / 2
            quiet.append((r, k, a, b, (a + b) / 2))
        quiet += [(r, 200 + j, x[2], x[3], (x[2] + x[3]) / 2) for j, x in enumerate(notes[-40::5])]  # at a note's bounds
    n = P.gap_phrases(spark.createDataFrame(notes, "recording_id long, note_id long, start double, end double, start_us long, end_us long"), 0.5)
    q = spark.createDataFrame(quiet, "recording_id long, run long, start double, end double, mid double")
    one, other = P.split_in_order(n, q), P.split_by_silence(n, q)
    assert one.dtypes == [next(x for x in other.dtypes if x[0] == c) for c in one.columns]
    assert rows(one) == rows(other) and one.where("part > 2").count() and not one.where("recording_id is null and part > 0").count()


def test_analysis_deals_frames_out_once(spark):
    """frames were read, dealt out and sorted for events, turns and silences each, joined twice, the notes merged twice; each use of
    a neighbour in the gradient was a window function of its own."""
    plan = str(Q.QUERIES["command_analyse"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString())
    assert plan.count("MapInPandas") == 1 and plan.count("Relation [") <= 2 and "Join" not in plan
    assert len(re.findall(r"(?:lag|lead)\(midi", plan)) == 2


def test_clusters_hold_every_phrase_and_step(spark, odd, tmp_path):
    """Round 4, F1: steps from or to a note without a pitch were left out of a cluster's key, and of its phrases all but a count and
    the first recording."""
    from melodex.queries.sequences import phrases

    con = duckdb.connect()
    con.execute(f"copy (select * replace (nullif(user_id, 3) as user_id) from '{odd}/events.parquet') to '{tmp_path}/events.parquet'")
    notes: dict = {}
    for n in phrases(spark, str(tmp_path)).orderBy("start_us", "note_id").select("recording_id", "phrase", "midi").collect():
        notes.setdefault((n["recording_id"], n["phrase"]), []).append(None if n["midi"] is None else round(n["midi"]))
    clusters: dict = {}
    for at, pitches in notes.items():
        steps = ",".join("?" if None in x else str(x[1] - x[0]) for x in zip(pitches, pitches[1:]))
        clusters.setdefault(steps, []).append(at)
    want = []
    for steps, members in clusters.items():
        first = min((x for x in members if x[0] is not None), default=(None, None))
        want += [(*at, steps, len(members), *first) for at in members]
    assert {None} < {r for r, *_ in want} and any("?" in x[2] for x in want) and any(x[3] > 1 and x[2] for x in want)
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    columns = ["recording_id", "phrase", "steps", "phrases", "first_recording", "first_phrase"]
    found = Q.QUERIES["cluster_phrases"](spark, str(tmp_path))
    assert found.columns == columns and sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert sorted(con.execute(f"select {', '.join(columns)} from ({Q.ORACLE['cluster_phrases']})").fetchall(), key=str) == sorted(want, key=str)


def test_a_cluster_is_counted_in_pieces(spark, monkeypatch):
    """Round 4, F1: a third of all phrases have one note, and so one key. The phrases are worked out once for both uses."""
    from melodex.operators import phrases as P

    data = [(r, p, "" if p % 3 else str(r % 5)) for r in range(40) for p in range(9)]
    steps = spark.createDataFrame(data, "recording_id long, phrase long, steps string")
    found = rows(P.clusters(steps))
    assert len(found) == len(data) and {x["steps"]: x["phrases"] for x in P.clusters(steps).collect()} == {"": 240} | {str(i): 24 for i in range(5)}
    monkeypatch.setattr(P, "PIECES", 1)
    assert rows(P.clusters(steps)) == found
    plan = str(Q.QUERIES["cluster_phrases"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString())
    assert "isnotnull(_piece" not in plan and "Filter" not in plan


def test_analysis_gives_the_phrases_of_its_clusters(spark):
    """Round 4, F1: the command's clusters were counts alone too."""
    from melodex.plans import commands as C
    from melodex.sources import adapters as S

    made = C.analyse(S.frames(spark, DATA))
    known = made["notes"].select("recording_id", "phrase").distinct()
    found = made["clusters"].collect()
    sizes: dict = {}
    for x in found:
        sizes.setdefault(tuple(x["steps"]), []).append((x["recording_id"], x["phrase"]))
    assert sorted(at for v in sizes.values() for at in v) == sorted(map(tuple, known.collect())) and len(sizes) > 5
    assert all((x["phrases"], (x["first_recording"], x["first_phrase"])) == (len(v), min(v)) for x in found for v in [sizes[tuple(x["steps"])]])
