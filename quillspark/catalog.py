"""All queries of the core library."""

from __future__ import annotations

from quillspark.plans import answers, cleaning, corpus, inout, judging, log, pipeline, records, reports, retrieval

MODULES = [retrieval.R, pipeline.R, corpus.R, cleaning.R, log.R, inout.R, answers.R, judging.R, records.R, reports.R]


def queries():
    return {k: f for r in MODULES for k, f in r.queries.items()}


def oracle_sql():
    return {k: s for r in MODULES for k, s in r.sql.items()}
