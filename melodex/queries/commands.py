"""The whole commands over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import commands as P
from ..sources import adapters as S
from . import language, scoring
from .registry import Registry

R = Registry()


@R("command_detect", scoring.R.oracle["score_candidates"])
def command_detect(spark, d):
    """The same ranks as ``score_candidates``, by the command."""
    c = P.detect(S.frames(spark, d), S.scales(spark, d), P.Settings(band=(20, 80)))["candidates"]
    return c.select("recording_id", "scale_id", "tonic", F.round("fit", 6).alias("fit"), F.round("primary", 6).alias("primary_score"), "salience", "rank")


@R("command_analyse")
def command_analyse(spark, d):
    return P.analyse(S.frames(spark, d))["phrases"].select("recording_id", "phrase", "notes", "start", "end")


@R("command_evaluate", language.R.oracle["mrr_topk"])
def command_evaluate(spark, d):
    return P.evaluate(language.tokens(spark, d).withColumnRenamed("track", "token"))["summary"]


QUERIES, ORACLE = R.queries, R.oracle
