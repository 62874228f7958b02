"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, code, details, relations, searches


def _wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Whole numbers come as long, so that schemas agree with the SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")})

    run.__doc__ = query.__doc__
    return run


_all = searches.QUERIES | blocks.QUERIES | relations.QUERIES | code.QUERIES | details.QUERIES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _wide(f) for name, (f, _) in _all.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _all.items() if sql}
