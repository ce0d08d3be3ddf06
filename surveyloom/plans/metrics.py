"""The metrics that queries may name."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Metric:
    key: str
    column: str | None
    aggregation: str
    low: float
    high: float | None
    format: str


METRICS = {
    m.key: m
    for m in (
        Metric("nps", "nps_score", "avg", -1.0, 1.0, "score"),
        Metric("csat", "csat_score", "avg", -1.0, 1.0, "score"),
        Metric("professionalism", "professionalism_score", "avg", -1.0, 1.0, "score"),
        Metric("survey_volume", None, "count", 0.0, None, "count"),
    )
}


def metric(name: str) -> Metric:
    """Looked up without regard to case."""
    if (key := str(name).strip().lower()) not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[key]
