"""Registry of the engine's queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: make a query known under its operator id."""

    def wrap(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLE[name] = oracle
        return f

    return wrap


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, volatility, drawdown and beta of every instrument, side by side."""
    from tidemark.operators import indicators as ind
    from tidemark.tables import bars

    every = bars(spark, sf_dir)
    bench = every.where("instrument_id = 0")
    out = ind.cumulative_return(every).select("instrument_id", "n", "status", F.col("value").alias("cumulative_return"))
    for name, df in (("volatility", ind.volatility(every, 252)), ("drawdown", ind.maximum_drawdown(every)), ("beta", ind.beta(every, bench))):
        out = out.join(df.select("instrument_id", F.col("value").alias(name)), "instrument_id", "left")
    return out


def _load() -> None:
    from tidemark.plans import disclosures, evidence, filings, guards, invariants, leads, ledgers, market, more, operations, remaining, research, telemetry  # noqa: F401


_load()
