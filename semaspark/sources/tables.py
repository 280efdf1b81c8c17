"""Tables: Parquet, CSV, history; SQL text with parameters; row guards."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Registry:
    """Tables of one directory by name, read when first asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._read[name]

    def sql(self, text: str, **params: object) -> DataFrame:
        """SQL over the tables it names; ``:name`` takes a parameter. Views are
        bound when the text is analysed, so directories don't mix."""
        for name in RELATIONAL:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=params or None)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, a fixed schema and empty fields as nulls."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("quote", '"').option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical CSV: sorted rows, LF line ends, nulls as empty fields. Range
    partitioning keeps the order over as many files as the data needs."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)


def render_sql(text: str, params: dict[str, object]) -> str:
    """``$name`` with the values of parameters, the longest names first; dates
    become DATE literals."""
    for name in sorted(params, key=len, reverse=True):
        v = params[name]
        text = re.sub(rf"\${re.escape(name)}\b", f"DATE '{v.isoformat()}'" if isinstance(v, date) else str(v), text)
    return text


class RowLimitError(RuntimeError):
    """A result with more rows than allowed."""


def guarded(df: DataFrame, most: int = 10_000) -> list:
    """Rows of a result that may not have more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise RowLimitError(f"the result has more than {most} rows")
    return rows


class TruthEngine(Protocol):
    """What runs independently written SQL."""

    def query(self, sql: str, most: int) -> list: ...

    def close(self) -> None: ...


class SparkTruth:
    """Ground truth from Spark SQL, remembered by text."""

    def __init__(self, registry: Registry):
        self.registry, self._seen = registry, {}

    def query(self, sql: str, most: int = 10_000) -> list:
        if sql not in self._seen:
            self._seen[sql] = guarded(self.registry.sql(sql), most)
        return self._seen[sql]

    def close(self) -> None:
        self._seen.clear()


class DuckTruth:
    """Ground truth from DuckDB over the same files."""

    def __init__(self, root: str):
        import duckdb

        self.con = duckdb.connect()
        for name in RELATIONAL:
            self.con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")

    def query(self, sql: str, most: int = 10_000) -> list:
        rows = self.con.execute(sql).fetchmany(most + 1)
        if len(rows) > most:
            raise RowLimitError(f"the result has more than {most} rows")
        return rows

    def close(self) -> None:
        self.con.close()


def vendor_rows(spark: SparkSession, payload: dict, dimensions: list[str], measures: list[str]) -> DataFrame:
    """Rows of another system's answer: dimensions first, then measures; numbers
    given as text become doubles."""
    rows = [[r.get(c) for c in [*dimensions, *measures]] for r in payload.get("rows", [])]
    text = [[None if v is None else str(v) for v in r] for r in rows]
    df = spark.createDataFrame(text, T.StructType([T.StructField(c, T.StringType()) for c in [*dimensions, *measures]]))
    return df.select(*[F.col(f"`{c}`") for c in dimensions], *[F.col(f"`{m}`").try_cast("double").alias(m) for m in measures])


Reader = Callable[[str], DataFrame]
