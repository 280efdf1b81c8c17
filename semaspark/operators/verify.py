"""Verification: tolerant comparison, fingerprints, statuses and baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.functions.scalar import six_digits


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Both null, or within ``absolute + relative * max(|a|, |b|)``; a relative
    tolerance of 0 stands for 1e-9."""
    a, b = a.cast("double"), b.cast("double")
    near = F.abs(a - b) <= F.lit(absolute) + F.lit(relative or 1e-9) * F.greatest(F.abs(a), F.abs(b))
    return (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def compare_rows(expected: DataFrame, actual: DataFrame, keys: list[str], relative: float = 1e-9, absolute: float = 0.0) -> DataFrame:
    """One row per mismatch: the keys, ``kind`` (missing, unexpected, value),
    ``column``, ``expected`` and ``actual`` as text. Rows of equal keys pair up
    in the order of their values, so any multiset can be compared."""
    values = [c for c in expected.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(*values) if values else Window.partitionBy(*keys).orderBy(F.lit(1))
    a = expected.withColumn("__n", F.row_number().over(order)).alias("a")
    b = actual.select(*expected.columns).withColumn("__n", F.row_number().over(order)).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in [*keys, "__n"]])
    both = a.join(b, on, "full")
    text = lambda side, c: F.col(f"{side}.`{c}`").cast("string")
    checks = []
    for c in values:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        same = close(x, y, relative, absolute) if _numeric(expected.schema[c].dataType) else x.eqNullSafe(y)
        checks.append(F.when(~same, F.struct(F.lit("value").alias("kind"), F.lit(c).alias("column"), text("a", c).alias("expected"), text("b", c).alias("actual"))))
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    found = F.when(F.col("a.__n").isNull(), whole("unexpected")).when(F.col("b.__n").isNull(), whole("missing"))
    found = found.otherwise(F.filter(F.array(*checks), lambda m: m.isNotNull())) if checks else found
    named = both.select(*[F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in keys], F.explode(found).alias("m"))
    return named.select(*keys, "m.kind", "m.column", "m.expected", "m.actual")


def row_text(df: DataFrame) -> Column:
    """A row as canonical text: numbers to six significant digits, nulls empty."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts.append(six_digits(c.cast("double")) if _numeric(f.dataType) else F.coalesce(c.cast("string"), F.lit("")))
    return F.concat_ws("\x1f", *parts)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: ``fingerprint``, whatever the order of rows, and ``n_rows``.
    Row hashes are summed in pieces, so nothing is gathered in one place."""
    h = F.sha2(row_text(df), 256)
    piece = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    sums = df.select(*[piece(i).alias(f"p{i}") for i in range(8)]).agg(*[F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("string").alias(f"p{i}") for i in range(8)], F.count(F.lit(1)).alias("n_rows"))
    return sums.select(F.substring(F.sha2(F.concat_ws(",", *[f"p{i}" for i in range(8)], F.col("n_rows").cast("string")), 256), 1, 16).alias("fingerprint"), "n_rows")


def fold_status(error: Column, refusal: Column, structural: Column, rows_ok: Column, truth_changed: Column) -> Column:
    """Status of a test from its checks. ``refusal`` is null unless the test or
    the answer refuses; ``structural`` is an array of verdicts, null where the
    answer gives nothing to check; ``rows_ok`` is null if rows weren't compared.
    Without any verdict a test is skipped. Moved ground truth makes drift of an
    answer only where its rows follow the new truth."""
    known = F.filter(structural, lambda x: x.isNotNull())
    sound, followed = F.forall(known, lambda x: x), F.coalesce(rows_ok, F.lit(False))
    return (
        F.when(F.coalesce(error, F.lit(False)), "error")
        .when(refusal.isNotNull(), F.when(refusal, "pass").otherwise("fail"))
        .when((F.size(known) == 0) & rows_ok.isNull(), "skipped")
        .when(sound & followed & F.coalesce(truth_changed, F.lit(False)), "drift")
        .when(sound & (followed | rows_ok.isNull()), "pass")
        .when(followed, "degraded")
        .otherwise("fail")
    )


def latest_baseline(log: DataFrame) -> DataFrame:
    """The last baseline of each test of an append-only log (test_id, seq, ...)."""
    w = Window.partitionBy("test_id").orderBy(F.desc("seq"))
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def next_run_id(runs: DataFrame) -> str:
    seq = runs.agg(F.max("seq")).first()[0] or 0
    return f"run-{seq + 1:04d}"


def pass_rate(results: DataFrame, by: list[str]) -> DataFrame:
    """Tests, passes (drift passes), skipped ones and the rate of the rest in
    percent to one place, by some columns."""
    good = F.col("status").isin("pass", "drift")
    run = F.col("status") != "skipped"
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tests"), F.sum(good.cast("long")).alias("passing"), F.sum((~run).cast("long")).alias("skipped"),
        F.round(F.sum(good.cast("long")).cast("double") * 100 / F.nullif(F.sum(run.cast("long")), F.lit(0)), 1).alias("rate"),
    )
