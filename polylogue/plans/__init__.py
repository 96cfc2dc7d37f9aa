"""Named queries: each is a Spark plan over the driver's tables plus its DuckDB statement."""

from __future__ import annotations

from .registry import ORACLE, QUERIES


def load_all() -> None:
    """Import every query module so that all queries are registered."""
    from . import q_human, q_io, q_jobs, q_metrics, q_sampling, q_text  # noqa: F401


__all__ = ["ORACLE", "QUERIES", "load_all"]
