"""Deterministic small tables with the traps that tests rely on.

Every value is a hash of the row number and a seed, so tables are the same
whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = ("America/New_York", "America/Chicago", "America/Los_Angeles", "Europe/Berlin", "Asia/Tokyo")


def draw(key: str, seed: int) -> Column:
    """A number in [0, 1) by row."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def pick(key: str, seed: int, choices: dict[str, float]) -> Column:
    """A weighted choice by row."""
    total, upto, out = sum(choices.values()), 0.0, None
    u = draw(key, seed)
    for value, weight in choices.items():
        upto += weight / total
        out = F.when(u < upto, value) if out is None else out.when(u < upto, value)
    return out.otherwise(list(choices)[-1])


def customers(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """About 2 % test accounts; contacts at reserved domains and numbers."""
    i = F.col("customer_id")
    return spark.range(n).select(F.col("id").alias("customer_id")).select(
        i, F.concat(F.lit("Company "), i).alias("company_name"), F.concat(F.lit("contact"), i, F.lit("@example.com")).alias("email"),
        F.format_string("555-01%02d", F.pmod(i, F.lit(100))).alias("phone"), (draw("customer_id", seed) < 0.02).alias("is_test_account"),
    )


def orders(spark: SparkSession, n: int, n_customers: int, seed: int = 2) -> DataFrame:
    """Skewed customers, money in whole cents, one in two hundred deleted, test
    accounts buying five times as much."""
    u = draw("order_id", seed)
    base = spark.range(n).select(F.col("id").alias("order_id")).select("order_id", F.least(F.floor(F.pow(u, F.lit(3.0)) * n_customers), F.lit(n_customers - 1)).alias("customer_id"))
    own = customers(spark, n_customers).select("customer_id", "is_test_account")
    cents = F.floor(draw("order_id", seed + 1) * 500_000) + 500
    # Growth: later days are likelier.
    day = F.floor(F.sqrt(draw("order_id", seed + 2)) * 700).cast("int")
    return base.join(own, "customer_id").select(
        "order_id", "customer_id", F.timestamp_add("DAY", day, F.lit("2024-02-01 09:30:00").cast("timestamp_ntz")).alias("order_ts_utc"),
        ((cents * F.when(F.col("is_test_account"), 5).otherwise(1)) / 100).cast("decimal(12,2)").alias("gross_amount"), (draw("order_id", seed + 3) < 0.005).alias("is_deleted"),
    )


def shipments(placed: DataFrame, seed: int = 7) -> DataFrame:
    """Dirty statuses and local wall clocks of the warehouse's zone; what is not
    delivered yet has no delivery time."""
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.pmod(F.col("order_id"), F.lit(len(ZONES))) + 1).cast("int"))
    status = pick("order_id", seed, {"Shipped": 0.6, "shipped": 0.15, "SHIPPED ": 0.1, "Shipped - Partial": 0.1, "Pending": 0.05})
    local = F.convert_timezone(F.lit("UTC"), F.col("zone"), F.timestamp_add("HOUR", F.lit(30), F.col("order_ts_utc")))
    hours = (F.floor(draw("order_id", seed + 1) * 120) + 12).cast("int")
    return placed.withColumn("zone", zone).withColumn("status", status).withColumn("shipped_at_local", local).select(
        "order_id", "zone", "status", "shipped_at_local", F.when(F.col("status") != "Pending", F.timestamp_add("HOUR", hours, F.col("shipped_at_local"))).alias("delivered_at_local"),
    )


def refunds(placed: DataFrame, seed: int = 9, late: bool = False) -> DataFrame:
    """About 5 % of orders; a quarter of refunds comes 45 to 160 days later.
    ``late`` gives the delta of further ones, 40 % of the order's amount."""
    u = draw("order_id", seed)
    chosen = placed.where((u >= 0.05) & (u < 0.07)) if late else placed.where(u < 0.05)
    days = F.when(draw("order_id", seed + 1) < (1.0 if late else 0.25), 45 + F.floor(draw("order_id", seed + 2) * 116)).otherwise(1 + F.floor(draw("order_id", seed + 2) * 20)).cast("int")
    share = F.lit(0.4) if late else F.lit(0.1) + draw("order_id", seed + 3) * 0.8
    return chosen.select("order_id", F.timestamp_add("DAY", days, F.col("order_ts_utc")).alias("refunded_at_utc"), (F.col("gross_amount") * share).cast("decimal(12,2)").alias("refund_amount"))


def manifest(tables: dict[str, DataFrame]) -> dict[str, str]:
    """The fingerprint of each table."""
    from semaspark.operators.verify import fingerprint

    return {name: fingerprint(df).first()[0] for name, df in sorted(tables.items())}
