"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premisa.catalogue.views import with_views
from premisa.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str,
    sql: str | None = None,
    views: str = "",
    instead: dict[str, tuple[str, str]] | None = None,
):
    """Register a query; ``sql`` may use the named views (see ``premisa.catalogue.views``)."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return function(prepare(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql, instead)
        return function

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    """Rounded to six decimals, so that the order of a float sum does not matter."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def long_vector(df: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    """One row per coordinate: comparable without comparing arrays."""
    return df.select(*keys, F.posexplode(vector).alias("i", "_x")).select(
        *keys, "i", r6("_x", "value")
    )
