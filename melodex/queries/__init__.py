"""Registered queries of the melodic operators and their SQL, one module for each family."""

from __future__ import annotations

from . import catalog, commands, directions, edits, files, language, models, reports, runs, scalar, scoring, sequences, stream, sweeps

MODULES = (scalar, scoring, sequences, language, directions, files, catalog, reports, models, edits, sweeps, runs, stream, commands)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = "score_candidates"
