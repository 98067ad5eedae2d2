"""An editor's log over notes and phrases: undo and redo resolved, then replayed over each note by itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A log's columns: what was done, in the order of seq, and its values as they were committed. phrase: the one that takes (merge,
#: bounds) or gives (split); other: the one that is taken in, or made; lo and hi: a range, bounds, or the split note's own times.
LOG = "recording_id long, seq long, op string, note_id long, phrase string, other string, lo double, hi double, midi double"
SHORTEST = 1e-3


def _applied(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq", ignore_index=True)
    done, undone = [], []
    for i, op in enumerate(rows["op"]):
        if op == "undo":
            if done:
                undone.append(done.pop())
        elif op == "redo":
            if undone:
                done.append(undone.pop())
        elif op != "open":
            done.append(i)
            undone.clear()
    return rows.iloc[done][["recording_id", "seq"]]


def effective(log: DataFrame) -> DataFrame:
    """The edits of a log that are in force at its end. ``undo`` takes back the last edit in force, ``redo`` gives back what was
    last taken back unless an edit was made since; without any they do nothing. ``open`` begins a session with nothing to take
    back: at these places the state is known, so a session, made by one hand, is worked through by itself."""
    w = Window.partitionBy("recording_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    steps = log.select("recording_id", "seq", "op", F.sum((F.col("op") == "open").cast("int")).over(w).alias("_session"))
    kept = steps.groupBy("recording_id", "_session").applyInPandas(_applied, "recording_id long, seq long")
    return log.join(kept, ["recording_id", "seq"], "left_semi")


def _step(s: Column, e: Column) -> Column:
    """A note's state (alive, start, end, phrase) after one more edit."""
    note, lo, hi = F.col("note_id"), F.least(e["lo"], e["hi"]), F.greatest(e["lo"], e["hi"])
    its, within = e["note_id"] == note, (s["end"] >= lo) & (s["start"] <= hi)
    born = (e["op"] == "add") & (e["seq"] == F.col("born"))
    dies = ((e["op"] == "delete") & its) | ((e["op"] == "delete_range") & within)
    moved = (e["op"] == "bounds") & its
    behind = F.struct(s["start"], s["end"], note) > F.struct(e["lo"], e["hi"], e["note_id"])
    phrase = (
        F.when((e["op"] == "merge") & (s["phrase"] == e["other"]), e["phrase"])
        .when((e["op"] == "split") & (s["phrase"] == e["phrase"]) & behind, e["other"])
        .when((e["op"] == "phrase_bounds") & within, e["phrase"])
        .when((e["op"] == "phrase_bounds") & (s["phrase"] == e["phrase"]), F.concat(F.lit("auto-"), note.cast("string")))
        .otherwise(s["phrase"])
    )
    alive = F.when(s["alive"], ~dies).otherwise(born)
    keeps = ~s["alive"]
    return F.struct(
        F.coalesce(alive, F.lit(False)).alias("alive"),
        F.when(~keeps & moved, lo).otherwise(s["start"]).alias("start"),
        F.when(~keeps & moved, F.when(hi > lo, hi).otherwise(lo + SHORTEST)).otherwise(s["end"]).alias("end"),
        F.when(keeps, s["phrase"]).otherwise(phrase).alias("phrase"),
    )


def replay_session(notes: DataFrame, log: DataFrame) -> DataFrame:
    """Notes (recording_id, note_id, start, end, midi, phrase) after the edits of a log (``LOG``) that are in force, in order.

    delete: a note goes; delete_range: all notes go that reach into a range, its ends included, as they stand then; bounds: a note
    gets new times, the earlier first, a thousandth apart at least; add: a note of a new id, from lo to hi, in its phrase; merge: a
    phrase takes another's notes in; split: the notes of a phrase behind one of it, by times and id, make another; phrase_bounds: a
    phrase gets all notes that reach into a range, and its others are left alone, each a phrase of its own. What happens to a note
    that is gone, or not there yet, does nothing; ids are never made twice.

    Edits are what hands make, notes what tasks hold: a recording's edits in force travel as one array to its notes, and each
    note folds over them by itself, so no task holds a recording's notes.
    """
    force = effective(log)
    fields = ["seq", "op", "note_id", "phrase", "other", "lo", "hi", "midi"]
    arrays = force.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_edits"))
    added = force.where("op = 'add'").select("recording_id", "note_id", F.least("lo", "hi").alias("start"), F.greatest("lo", "hi").alias("end"), "midi", "phrase", F.col("seq").alias("born"))
    every = notes.select("recording_id", "note_id", "start", "end", "midi", "phrase", F.lit(None).cast("long").alias("born")).unionByName(added)
    met = every.join(arrays, "recording_id", "left")
    begin = F.struct(F.col("born").isNull().alias("alive"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("phrase").alias("phrase"))
    state = F.when(F.col("_edits").isNull(), begin).otherwise(F.aggregate("_edits", begin, _step))
    met = met.select("recording_id", "note_id", "midi", state.alias("s")).where("s.alive")
    return met.select("recording_id", "note_id", "s.start", "s.end", "midi", "s.phrase")


def phrase_table(notes: DataFrame) -> DataFrame:
    """(recording_id, phrase, start, end, notes): phrases as their notes have them; one without notes is none."""
    return notes.groupBy("recording_id", "phrase").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("notes"))
