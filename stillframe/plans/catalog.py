"""All frame-analytics queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stillframe.operators import acceptance, consensus, extras, files, frames, geometry, imaging, merge, perframe, planted, predict, prediction, ranking, reports, runs, settings, spectra, tracking  # noqa: F401  they register
from stillframe.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
