"""All queries over the driver's tables, by name, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidweave.plans import queries, stateful
from bidweave.plans.oracles import ORACLES as _ORACLES
from bidweave.session import ship


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {name: _shipped(f) for name, f in {**queries.QUERIES, **stateful.QUERIES}.items()}
ORACLES = {**_ORACLES, **stateful.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["top_products_by_roas"](spark, sf_dir)
