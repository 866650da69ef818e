"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Registered queries always read the given tables (or views Spark derives from
them) in full.  Double columns are rounded to 6 places at the end so that the
oracle comparison is not at the mercy of summation order.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            from tessera.session import ship_package
            ship_package(spark)
            return round_doubles(fn(spark, sf_dir))
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = wrapped
        return wrapped
    return deco


def all_queries() -> dict[str, QueryFn]:
    # Importing the query modules fills QUERIES.
    from tessera.plans import queries  # noqa: F401
    return dict(QUERIES)
