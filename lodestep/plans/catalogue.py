"""Registry of the queries over the reference's own operators."""

from __future__ import annotations

from lodestep.plans import control_queries, corpus_queries, corruption_queries, folder_queries, loss_queries, metric_queries, panel_queries, probe_queries, resample_queries, text_queries, vector_queries, report_queries, detail_queries, damage_queries, file_queries  # noqa: F401
from lodestep.plans.registry import QUERIES, Query


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
