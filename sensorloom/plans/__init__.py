"""Every registered query of the telemetry engine."""

from __future__ import annotations

from sensorloom.plans import evaluation, joins, metrics, registry, rows, stateful, stores, windows

MODULES = (joins, windows, rows, metrics, stateful, evaluation, stores)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
