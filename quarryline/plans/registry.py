"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarryline.plans import fixtures
from quarryline.sources import readers


# Tables whose text work outweighs moving their rows between tasks.
TEXT_SOURCES = ("documents", "orders")


class Tables:
    """Driver tables and the tables derived from them, read lazily by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.DERIVED:
            return fixtures.derive(self, name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return readers.spread(table) if name in TEXT_SOURCES else table


@dataclass(frozen=True)
class Check:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None, *, longs: str = "", doubles: str = ""):
    """Registers a query; its SQL may use any derived table by name.

    `longs` and `doubles` name twin columns whose type SQL would widen or narrow.
    """

    def register(build: Callable[[Tables], DataFrame]):
        CHECKS[name] = Check(build, None if sql is None else _typed(sql, longs, doubles))
        return build

    return register


def _typed(sql: str, longs: str, doubles: str) -> str:
    text = fixtures.with_ctes(sql)
    casts = [f"cast({c} AS bigint) AS {c}" for c in longs.split()]
    casts += [f"cast({c} AS double) AS {c}" for c in doubles.split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({text}) typed" if casts else text


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return CHECKS[name].build(Tables(spark, sf_dir))

    run.__name__ = name
    return run
