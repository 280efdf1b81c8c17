"""Registered queries of the semantic engine and their DuckDB oracles.

The oracles are written against the tables on their own, never through the
semantic layer.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.functions import fiscal
from semaspark.functions.scalar import fuzzy_equal_udf, hour_diff, local_to_utc, normalise, normalised_status, ratio
from semaspark.operators import lineage, lint, verify
from semaspark.plans.model import SemanticModel, Workspace, resolve
from semaspark.plans.planner import Filter, Planner, SemanticQuery
from semaspark.sources.tables import Registry

Query = Callable[[SparkSession, str], DataFrame]
#: The day as of which relative periods are taken.
AS_OF = date(2001, 8, 2)
WINDOW = Filter("orders.ordered_date", start=date(1996, 2, 1), end=date(1998, 2, 1))

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


@lru_cache(maxsize=1)
def retail() -> SemanticModel:
    root = Path(__file__).parent / "models" / "retail"
    return resolve(Workspace([root]), "retail")


def planner(spark: SparkSession, sf_dir: str) -> Planner:
    tables = Registry(spark, sf_dir)
    return Planner(retail(), tables.table, tables.sql)


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def semantic(name: str, oracle: str, explore: str, fields: str, *filters: Filter, **how: object) -> None:
    """Register a semantic query; its columns are those of the oracle in order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = SemanticQuery(explore, tuple(fields.split()), filters, **how)  # type: ignore[arg-type]
        return dates_as_text(normalise(planner(spark, sf_dir).frame(q)))

    register(name, oracle)(run)


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates in ISO form, which every client reads alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


# Text shared by oracles: the guarded orders with their customers.
_GUARD = "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE NOT (c.c_acctbal < 0) AND NOT (o.o_orderstatus = 'P')"
_TOTAL = "CAST(o.o_totalprice AS DECIMAL(12,2))"
_IN_WINDOW = " AND o.o_orderdate >= TIMESTAMP '1996-02-01' AND o.o_orderdate < TIMESTAMP '1998-02-01'"
_FY = "(year({d}) + CASE WHEN month({d}) >= 2 THEN 1 ELSE 0 END)"
_FQ = "'FY' || CAST(" + _FY + " AS VARCHAR) || '-Q' || CAST(((month({d}) + 10) % 12) // 3 + 1 AS VARCHAR)"
_OD_FQ, _OD_FY = _FQ.format(d="o.o_orderdate"), _FY.format(d="o.o_orderdate")
_PLACED = (
    "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey "
    "LEFT JOIN (SELECT l_orderkey, SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END) AS returned FROM lineitem GROUP BY l_orderkey) x ON o.o_orderkey = x.l_orderkey "
    "WHERE NOT (c.c_acctbal < 0) AND NOT (o.o_orderstatus = 'P')"
)
_SUM = f"CAST(SUM({_TOTAL}) AS DOUBLE)"

# -- scans, projections, filters

semantic("scan_project_orders", f"SELECT DISTINCT o.o_orderkey AS orders__order_key, o.o_orderstatus AS orders__status, CASE WHEN o.o_orderstatus = 'P' THEN 'Yes' ELSE 'No' END AS orders__is_pending {_GUARD}", "orders", "orders.order_key orders.status orders.is_pending")
semantic("dims_distinct_priority", f"SELECT DISTINCT o.o_orderpriority AS orders__priority {_GUARD}", "orders", "orders.priority")
semantic("filter_in", f"SELECT COUNT(DISTINCT o.o_orderkey) AS orders__order_count {_GUARD} AND c.c_mktsegment IN ('BUILDING', 'MACHINERY')", "orders", "orders.order_count", Filter("customers.segment", ("BUILDING", "MACHINERY")))
semantic("filter_not_in", f"SELECT c.c_mktsegment AS customers__segment, COUNT(DISTINCT o.o_orderkey) AS orders__order_count {_GUARD} AND c.c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1", "orders", "customers.segment orders.order_count", Filter("customers.segment", ("-BUILDING", "-MACHINERY")))
semantic("filter_yesno_yes", "SELECT COUNT(DISTINCT o_orderkey) AS orders__order_count FROM orders WHERE COALESCE(CAST(o_totalprice AS DECIMAL(12,2)) > 200000, FALSE)", "orders", "orders.order_count", Filter("orders.is_large", ("yes",)), guarded=False)
semantic("filter_yesno_no", "SELECT COUNT(DISTINCT o_orderkey) AS orders__order_count FROM orders WHERE NOT COALESCE(CAST(o_totalprice AS DECIMAL(12,2)) > 200000, FALSE)", "orders", "orders.order_count", Filter("orders.is_large", ("no",)), guarded=False)
semantic("filter_window", f"SELECT o.o_orderpriority AS orders__priority, {_SUM} AS orders__gross_revenue {_GUARD}{_IN_WINDOW} GROUP BY 1", "orders", "orders.priority orders.gross_revenue", WINDOW)
semantic("filter_measure", f"SELECT * FROM (SELECT n.n_name AS nations__nation_name, COUNT(DISTINCT o.o_orderkey) AS orders__order_count {_PLACED} GROUP BY 1) WHERE orders__order_count > 200", "orders", "nations.nation_name orders.order_count", Filter("orders.order_count", (">200",)))
semantic("guard_always_where", f"SELECT COUNT(DISTINCT o.o_orderkey) AS orders__order_count {_GUARD}", "orders", "orders.order_count")
semantic("guard_lifted", "SELECT COUNT(DISTINCT o_orderkey) AS orders__order_count FROM orders", "orders", "orders.order_count", guarded=False)
semantic("always_filter_default", "SELECT o_orderstatus AS orders__status, COUNT(DISTINCT o_orderkey) AS orders__order_count FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1", "all_orders", "orders.status orders.order_count")
semantic("always_filter_replaced", "SELECT o_orderstatus AS orders__status, COUNT(DISTINCT o_orderkey) AS orders__order_count FROM orders WHERE o_orderstatus = 'P' GROUP BY 1", "all_orders", "orders.status orders.order_count", Filter("orders.is_pending", ("yes",)))

# -- joins

semantic("join_left_star", f"SELECT r.r_name AS regions__region_name, n.n_name AS nations__nation_name, {_SUM} AS orders__gross_revenue {_PLACED} GROUP BY 1, 2", "orders", "regions.region_name nations.nation_name orders.gross_revenue")
semantic("join_inner", "SELECT p.p_brand AS parts__brand, COUNT(*) AS lines__line_count FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey WHERE NOT (o.o_orderstatus = 'P') GROUP BY 1", "lines", "parts.brand lines.line_count")
semantic("join_full_outer", "SELECT n.n_name AS nations__nation_name, COUNT(DISTINCT s.s_suppkey) AS suppliers__supplier_count FROM nation n FULL JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_suppkey <= 40 GROUP BY 1", "supplier_nations", "nations.nation_name suppliers.supplier_count")
semantic("join_role_playing_calendar", f"SELECT {_FQ.format(d='l.l_shipdate')} AS shipped_fiscal__fiscal_quarter, {_OD_FY} AS ordered_fiscal__fiscal_year, COUNT(*) AS lines__line_count FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE NOT (o.o_orderstatus = 'P') GROUP BY 1, 2", "lines", "shipped_fiscal.fiscal_quarter ordered_fiscal.fiscal_year lines.line_count")
semantic("join_pruned", f"SELECT o.o_orderstatus AS orders__status, {_SUM} AS orders__gross_revenue {_GUARD} GROUP BY 1", "orders", "orders.status orders.gross_revenue")

# -- measures

semantic("measure_count_star", "SELECT l.l_returnflag AS lines__return_flag, COUNT(*) AS lines__line_count FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE NOT (o.o_orderstatus = 'P') GROUP BY 1", "lines", "lines.return_flag lines.line_count")
semantic("measure_count_pk", f"SELECT c.c_mktsegment AS customers__segment, COUNT(DISTINCT c.c_custkey) AS customers__customer_count {_GUARD} GROUP BY 1", "orders", "customers.segment customers.customer_count")
semantic("measure_count_distinct", f"SELECT o.o_orderpriority AS orders__priority, COUNT(DISTINCT o.o_custkey) AS orders__active_customers {_GUARD} GROUP BY 1", "orders", "orders.priority orders.active_customers")
semantic("measure_sum", f"SELECT {_SUM} AS orders__gross_revenue {_GUARD}", "orders", "orders.gross_revenue")
semantic("measure_min_max", f"SELECT o.o_orderstatus AS orders__status, CAST(MIN({_TOTAL}) AS DOUBLE) AS orders__smallest_total, CAST(MAX({_TOTAL}) AS DOUBLE) AS orders__largest_total {_GUARD} GROUP BY 1", "orders", "orders.status orders.smallest_total orders.largest_total")
semantic("measure_filtered_sum", f"SELECT o.o_orderpriority AS orders__priority, CAST(SUM(CASE WHEN o.o_orderstatus = 'F' THEN {_TOTAL} END) AS DOUBLE) AS orders__finished_revenue {_GUARD} GROUP BY 1", "orders", "orders.priority orders.finished_revenue")
semantic("measure_filtered_count", "SELECT l.l_linestatus AS lines__line_status, COUNT(CASE WHEN l.l_returnflag = 'R' THEN 1 END) AS lines__returned_count FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE NOT (o.o_orderstatus = 'P') GROUP BY 1", "lines", "lines.line_status lines.returned_count")
semantic("measure_filtered_count_pk", "SELECT o_orderpriority AS orders__priority, COUNT(DISTINCT CASE WHEN COALESCE(o_orderstatus = 'P', FALSE) THEN o_orderkey END) AS orders__pending_count FROM orders GROUP BY 1", "orders", "orders.priority orders.pending_count", guarded=False)
semantic("measure_ratio", f"SELECT o.o_orderpriority AS orders__priority, {_SUM} / NULLIF(COUNT(DISTINCT o.o_orderkey), 0) AS orders__average_order_value {_GUARD} GROUP BY 1", "orders", "orders.priority orders.average_order_value")
semantic("measure_cross_view_net", f"SELECT r.r_name AS regions__region_name, CAST(SUM({_TOTAL} - COALESCE(x.returned, 0)) AS DOUBLE) AS orders__net_revenue {_PLACED} GROUP BY 1", "orders", "regions.region_name orders.net_revenue")
semantic("derived_table_facts", f"SELECT o.o_orderstatus AS orders__status, CAST(SUM(x.returned) AS DOUBLE) AS returns__total_returned {_PLACED} GROUP BY 1", "orders", "orders.status returns.total_returned")

# -- time

for _frame, _sql in {
    "date": "CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR)", "week": "CAST(CAST(date_trunc('week', o.o_orderdate) AS DATE) AS VARCHAR)", "month": "strftime(o.o_orderdate, '%Y-%m')",
    "quarter": "CAST(year(o.o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o.o_orderdate) AS VARCHAR)", "year": "year(o.o_orderdate)", "raw": "o.o_orderdate",
}.items():
    semantic(f"timeframe_{_frame}", f"SELECT {_sql} AS orders__ordered_{_frame}, COUNT(DISTINCT o.o_orderkey) AS orders__order_count {_GUARD} GROUP BY 1", "orders", f"orders.ordered_{_frame} orders.order_count")
semantic("fiscal_quarter_revenue", f"SELECT {_OD_FQ} AS ordered_fiscal__fiscal_quarter, {_SUM} AS orders__gross_revenue {_GUARD} GROUP BY 1", "orders", "ordered_fiscal.fiscal_quarter orders.gross_revenue")
semantic("fiscal_year_filter", f"SELECT {_SUM} AS orders__gross_revenue {_GUARD} AND {_OD_FY} = 1999", "orders", "orders.gross_revenue", Filter("ordered_fiscal.fiscal_year", ("1999",)))
for _name, _period in {
    "last_completed_fiscal_quarter": fiscal.last_completed_fiscal_quarter(AS_OF), "last_completed_fiscal_year": fiscal.last_completed_fiscal_year(AS_OF),
    "last_month": fiscal.last_completed_month(AS_OF), "last_calendar_quarter": fiscal.last_calendar_quarter(AS_OF), "last_calendar_year": fiscal.last_calendar_year(AS_OF),
}.items():
    semantic(_name, f"SELECT COUNT(DISTINCT o.o_orderkey) AS orders__order_count, {_SUM} AS orders__gross_revenue {_GUARD} AND o.o_orderdate >= TIMESTAMP '{_period.start}' AND o.o_orderdate < TIMESTAMP '{_period.end}'", "orders", "orders.order_count orders.gross_revenue", Filter("orders.ordered_date", start=_period.start, end=_period.end))
semantic("case_normalised_status", f"SELECT CASE WHEN lower(trim(s)) = 'shipped' THEN 'Shipped' ELSE trim(s) END AS orders__dirty_status, COUNT(DISTINCT k) AS orders__order_count FROM (SELECT o.o_orderkey AS k, CASE WHEN o.o_orderstatus = 'F' THEN 'Shipped' WHEN o.o_orderpriority LIKE '1%' THEN 'SHIPPED ' WHEN o.o_orderstatus = 'O' THEN 'shipped' ELSE 'Shipped - Partial' END AS s FROM orders o) GROUP BY 1", "orders", "orders.dirty_status orders.order_count", guarded=False)
semantic("ordered_topn", f"SELECT * FROM (SELECT n.n_name AS nations__nation_name, {_SUM} AS orders__gross_revenue {_PLACED} GROUP BY 1 ORDER BY 2 DESC NULLS LAST LIMIT 5)", "orders", "nations.nation_name orders.gross_revenue", sorts=("orders.gross_revenue desc",), limit=5)

_FLAGSHIP = (
    f"SELECT {_OD_FQ} AS ordered_fiscal__fiscal_quarter, r.r_name AS regions__region_name, COUNT(DISTINCT o.o_orderkey) AS orders__order_count, {_SUM} AS orders__gross_revenue, "
    f"CAST(SUM(x.returned) AS DOUBLE) AS returns__total_returned, ROUND(CAST(SUM(x.returned) AS DOUBLE) / NULLIF({_SUM}, 0), 9) AS orders__return_rate {_PLACED}{_IN_WINDOW} GROUP BY 1, 2"
)
semantic("flagship_revenue_by_fiscal_quarter_region", _FLAGSHIP, "orders", "ordered_fiscal.fiscal_quarter regions.region_name orders.order_count orders.gross_revenue returns.total_returned orders.return_rate", WINDOW)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["flagship_revenue_by_fiscal_quarter_region"](spark, sf_dir)


# -- averages are rounded on both sides: doubles add up in another order


@register("measure_avg", f"SELECT o.o_orderpriority AS orders__priority, ROUND(AVG(CAST({_TOTAL} AS DOUBLE)), 4) AS orders__average_total {_GUARD} GROUP BY 1")
def _measure_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner(spark, sf_dir).frame(SemanticQuery("orders", ("orders.priority", "orders.average_total")))
    return out.select("orders__priority", F.round("orders__average_total", 4).alias("orders__average_total"))


@register("day_diff_avg", "SELECT l.l_returnflag AS lines__return_flag, ROUND(AVG(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))), 6) AS lines__average_days_to_ship FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE NOT (o.o_orderstatus = 'P') GROUP BY 1")
def _day_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = planner(spark, sf_dir).frame(SemanticQuery("lines", ("lines.return_flag", "lines.average_days_to_ship")))
    return out.select("lines__return_flag", F.round("lines__average_days_to_ship", 6).alias("lines__average_days_to_ship"))


@register("hour_diff_avg", "SELECT event_type, CAST(SUM(date_diff('hour', TIMESTAMP '2024-01-01', ts)) AS BIGINT) AS hours, ROUND(AVG(date_diff('hour', TIMESTAMP '2024-01-01', ts) / 24.0), 6) AS mean_days FROM events GROUP BY 1")
def _hour_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hour_diff(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return Registry(spark, sf_dir).table("events").groupBy("event_type").agg(F.sum(h).alias("hours"), F.round(F.avg(h / F.lit(24.0)), 6).alias("mean_days"))


@register("local_to_utc", "SELECT CAST(strftime(timezone('UTC', timezone(CASE WHEN user_id % 2 = 0 THEN 'America/New_York' ELSE 'Asia/Tokyo' END, ts)), '%Y-%m-%d') AS VARCHAR) AS utc_day, COUNT(*) AS n FROM events GROUP BY 1")
def _local_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("user_id") % 2 == 0, "America/New_York").otherwise("Asia/Tokyo")
    day = F.date_format(local_to_utc(zone, F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd")
    return Registry(spark, sf_dir).table("events").groupBy(day.alias("utc_day")).agg(F.count(F.lit(1)).alias("n"))


@register("normalised_status_counts", "SELECT CASE WHEN lower(trim(s)) = 'shipped' THEN 'Shipped' ELSE trim(s) END AS status, COUNT(*) AS n FROM (VALUES ('Shipped'), ('shipped'), ('SHIPPED '), ('Shipped - Partial'), (NULL)) t(s) GROUP BY 1")
def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("Shipped",), ("shipped",), ("SHIPPED ",), ("Shipped - Partial",), (None,)], "s string")
    return df.groupBy(normalised_status(F.col("s")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("fiscal_calendar", f"SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS calendar_date, {_FY.format(d='d')} AS fiscal_year, ((month(d) + 10) % 12) // 3 + 1 AS fiscal_quarter, {_FQ.format(d='d')} AS fiscal_quarter_label, (month(d) + 10) % 12 + 1 AS fiscal_month, CAST(make_date({_FY.format(d='d')} - 1, 2, 1) AS VARCHAR) AS fiscal_year_start, CAST(CAST(make_date({_FY.format(d='d')} - 1, 2, 1) + to_months(CAST(3 * (((month(d) + 10) % 12) // 3) AS INTEGER)) AS DATE) AS VARCHAR) AS fiscal_quarter_start FROM generate_series(DATE '2023-02-01', DATE '2027-01-31', INTERVAL 1 DAY) t(d)")
def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates_as_text(normalise(fiscal.calendar(spark, date(2023, 2, 1), date(2027, 2, 1))))


# -- SQL: star-plus projection, CTEs, scalar subqueries, one-row cross joins, anti joins


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query that Spark SQL and DuckDB can both run."""
    register(name, oracle or text)(lambda spark, sf_dir: normalise(Registry(spark, sf_dir).sql(text)))


sql("star_plus_projection", "SELECT o.*, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 2 AS DOUBLE) AS doubled FROM orders o WHERE o_orderstatus = 'F'")
sql("cte_scalar_subquery", "WITH cur AS (SELECT MAX(o_orderdate) AS d FROM orders), per AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS spent FROM orders WHERE year(o_orderdate) = (SELECT year(d) - 1 FROM cur) GROUP BY o_custkey) SELECT o_custkey, spent FROM per WHERE spent > 100000")
sql("join_cross_one_row", "WITH top AS (SELECT MAX(CAST(o_totalprice AS DECIMAL(12,2))) AS most FROM orders) SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS total FROM orders, top WHERE CAST(o_totalprice AS DECIMAL(12,2)) = most")
sql("cte_two_facts", "WITH o AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey), j AS (SELECT o.o_orderpriority, l.n FROM o JOIN l ON o.o_orderkey = l.l_orderkey) SELECT o_orderpriority, CAST(SUM(n) AS BIGINT) AS line_total, COUNT(*) AS orders_with_lines FROM j GROUP BY o_orderpriority")
sql("conditional_distinct_ratio", "SELECT o_orderpriority, 1.0D * COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) / NULLIF(COUNT(DISTINCT o_custkey), 0) AS share FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(1.0 AS DOUBLE) * COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) / NULLIF(COUNT(DISTINCT o_custkey), 0) AS share FROM orders GROUP BY o_orderpriority")
sql("join_using", "SELECT n_name, COUNT(*) AS customers FROM (SELECT c_nationkey AS k FROM customer) c JOIN (SELECT n_nationkey AS k, n_name FROM nation) n USING (k) GROUP BY n_name")


@register("anti_orders_without_lines", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def _anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Registry(spark, sf_dir)
    o, lines = t.table("orders"), t.table("lineitem")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left_anti").select("o_orderkey")


_LATE = """
WITH quarter AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '2001-05-01' AND o_orderdate < TIMESTAMP '2001-08-01' AND o_orderstatus <> 'P' AND c_acctbal >= 0)
SELECT o_orderkey, COUNT(*) AS lines, CAST(SUM(CAST(l_extendedprice * 0.4 AS DECIMAL(12,2))) AS DOUBLE) AS late FROM quarter JOIN lineitem l ON l_orderkey = o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = o_orderkey AND r.l_returnflag = 'R') GROUP BY o_orderkey
"""


@register("late_refund_delta", _LATE)
def _late_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of late refunds: orders of the last completed fiscal quarter,
    not deleted and of no test account, without a return; two fifths of each."""
    t = Registry(spark, sf_dir)
    window = fiscal.last_completed_fiscal_quarter(AS_OF)
    orders = t.table("orders").where((F.col("o_orderdate") >= F.lit(window.start)) & (F.col("o_orderdate") < F.lit(window.end)) & (F.col("o_orderstatus") != "P"))
    orders = orders.join(t.table("customer").where("c_acctbal >= 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    lines = t.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    each = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum((F.col("l_extendedprice") * 0.4).cast("decimal(12,2)")).cast("double").alias("late"), F.max(F.col("l_returnflag") == "R").alias("returned"))
    return each.where("not returned").drop("returned")


@register("fuzzy_value_match", "SELECT DISTINCT c_mktsegment AS customers__segment, 'buildng' AS asked FROM customer WHERE c_mktsegment = 'BUILDING'")
def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a dimension that a loosely written name may mean."""
    values = planner(spark, sf_dir).distinct_values("orders", "customers.segment")
    return values.where(fuzzy_equal_udf(F.col("customers__segment"), F.lit("buildng"))).withColumn("asked", F.lit("buildng"))


# -- verification

_CMP = "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1"


@register("verify_compare_rows", f"WITH a AS ({_CMP}), b AS (SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderpriority LIKE '1%' GROUP BY 1) SELECT a.o_orderpriority, 'value' AS kind, 'n' AS \"column\", CAST(a.n AS VARCHAR) AS expected, CAST(b.n AS VARCHAR) AS actual FROM a JOIN b USING (o_orderpriority) WHERE a.n <> b.n")
def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Registry(spark, sf_dir).table("orders")
    count = lambda df: df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return verify.compare_rows(count(orders), count(orders.where("o_orderkey % 7 <> 0 OR o_orderpriority LIKE '1%'")), ["o_orderpriority"], 1e-6)


_PRINT = """
WITH r AS (SELECT regexp_replace(printf('%.5e', CAST(c_custkey AS DOUBLE)), '\\.?0+e', 'e') || chr(31) || c_name || chr(31) || CASE WHEN c_acctbal = 0 THEN '0' ELSE regexp_replace(printf('%.5e', c_acctbal), '\\.?0+e', 'e') END AS t FROM customer WHERE c_custkey > 0),
h AS (SELECT sha256(t) AS h FROM r),
p AS (SELECT i, SUM(CAST(CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) AS HUGEINT)) AS s FROM h, range(8) u(i) GROUP BY i)
SELECT substr(sha256(string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) || ',' || CAST((SELECT COUNT(*) FROM r) AS VARCHAR)), 1, 16) AS fingerprint, (SELECT COUNT(*) FROM r) AS n_rows FROM p
"""


@register("verify_fingerprint", _PRINT)
def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.fingerprint(Registry(spark, sf_dir).table("customer").where("c_custkey > 0").select("c_custkey", "c_name", "c_acctbal"))


#: Verdicts (error, refusal, structural ones, rows, moved truth) and their status.
_FOLDS = [
    ("errs", True, None, [True], True, False, "error"), ("refuses", False, True, [], None, False, "pass"), ("answers", False, False, [], None, False, "fail"), ("bare", False, None, [], None, True, "skipped"),
    ("unseen", False, None, [None], None, False, "skipped"), ("good", False, None, [True, None], True, False, "pass"), ("moved", False, None, [True], True, True, "drift"), ("unchecked", False, None, [True], None, True, "pass"),
    ("odd", False, None, [True, False], True, True, "degraded"), ("wrong", False, None, [True], False, True, "fail"), ("values", False, None, [False], None, False, "fail"),
]


@register("verify_status_fold", "SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[-1]}')" for r in _FOLDS) + ") t(test, status)")
def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame([r[:-1] for r in _FOLDS], "test string, error boolean, refusal boolean, structural array<boolean>, rows_ok boolean, moved boolean")
    return frame.select("test", verify.fold_status(*map(F.col, ("error", "refusal", "structural", "rows_ok", "moved"))).alias("status"))


_RESULTS = [
    ("finance", "t1", "pass", "pass"), ("finance", "t2", "pass", "fail"), ("finance", "t3", "pass", "drift"), ("finance", "t4", "pass", "pass"),
    ("logistics", "t5", "fail", "pass"), ("logistics", "t6", "pass", "degraded"), ("logistics", "t7", "skipped", "skipped"), ("logistics", "t8", "pass", "fail"),
]
_VALUES = ", ".join(f"('{a}', '{t}', '{x}', '{y}')" for a, t, x, y in _RESULTS)


@register("pass_rates", f"SELECT agent, COUNT(*) AS tests, CAST(SUM(CASE WHEN now IN ('pass', 'drift') THEN 1 ELSE 0 END) AS BIGINT) AS passing, CAST(SUM(CASE WHEN now = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, ROUND(SUM(CASE WHEN now IN ('pass', 'drift') THEN 1 ELSE 0 END) * 100.0 / SUM(CASE WHEN now <> 'skipped' THEN 1 ELSE 0 END), 1) AS rate FROM (VALUES {_VALUES}) t(agent, test_id, was, now) GROUP BY 1")
def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(a, t, y) for a, t, _, y in _RESULTS], "agent string, test_id string, status string")
    return verify.pass_rate(df, ["agent"])


@register("trend", f"SELECT run_id, CAST(seq AS BIGINT) AS seq, agent, COUNT(*) AS tests, CAST(SUM(CASE WHEN status IN ('pass', 'drift') THEN 1 ELSE 0 END) AS BIGINT) AS passing FROM (SELECT 'run-0001' AS run_id, 1 AS seq, agent, was AS status FROM (VALUES {_VALUES}) t(agent, test_id, was, now) UNION ALL SELECT 'run-0002', 2, agent, now FROM (VALUES {_VALUES}) t(agent, test_id, was, now)) GROUP BY 1, 2, 3")
def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f"run-000{i + 1}", i + 1, r[0], r[2 + i]) for r in _RESULTS for i in range(2)]
    return normalise(lineage.trend(spark.createDataFrame(rows, "run_id string, seq int, agent string, status string")))


# -- lineage over small frames

_BEFORE = [("field:a.x", "semantic", "v1"), ("field:a.y", "semantic", "v1"), ("field:a.z", "surface", "v1")]
_AFTER = [("field:a.x", "semantic", "v2"), ("field:a.y", "semantic", "v1"), ("field:a.w", "semantic", "v1")]


def _elements(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(e, "field", f, v, "model:m", "f:1", {"sql": v}) for e, f, v in rows], lineage.ELEMENTS)


def _in(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows) + f") {names}"


_DIFF = f"SELECT COALESCE(b.e, a.e) AS element_id, COALESCE(b.f, a.f) AS facet, CASE WHEN a.e IS NULL THEN 'added' WHEN b.e IS NULL THEN 'removed' ELSE 'modified' END AS change FROM {_in(_BEFORE, 'a(e, f, v)')} FULL JOIN {_in(_AFTER, 'b(e, f, v)')} ON a.e = b.e AND a.f = b.f WHERE a.v IS DISTINCT FROM b.v"


@register("lineage_diff", _DIFF)
def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.diff(_elements(spark, _BEFORE), _elements(spark, _AFTER)).select("element_id", "facet", "change")


_DEPS = [("finance", "t2", "field:a.x", "semantic", "queried", 0), ("finance", "t4", "field:a.y", "semantic", "queried", 0), ("logistics", "t6", "field:a.x", "surface", "queried", 0), ("logistics", "t8", "field:a.x", "semantic", "context", 3)]


def _deps(spark: SparkSession) -> DataFrame:
    return lineage.dependencies(spark.createDataFrame(_DEPS, "agent string, test_id string, element_id string, facet string, role string, rank int"))


@register("lineage_impact", f"SELECT DISTINCT d.agent, d.test_id, 'changed' AS reason FROM {_in(_DEPS, 'd(agent, test_id, e, f, role, rk)')} JOIN ({_DIFF}) c ON d.e = c.element_id AND d.f = c.facet WHERE d.rk < 3")
def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = lineage.diff(_elements(spark, _BEFORE), _elements(spark, _AFTER))
    return lineage.impact(_deps(spark), changes, _deps(spark))


@register("lineage_verdicts", f"SELECT r.agent, r.test_id, r.was, r.now, CASE WHEN r.was = 'pass' AND r.now NOT IN ('pass', 'drift') THEN 'regression' WHEN r.was = 'fail' AND r.now = 'pass' THEN 'fix' ELSE 'other' END AS direction, CASE WHEN d.n = 1 THEN 'input' WHEN r.test_id = 't3' THEN 'data' ELSE 'external' END AS cause FROM {_in(_RESULTS, 'r(agent, test_id, was, now)')} LEFT JOIN (SELECT d.agent, d.test_id, COUNT(DISTINCT 'm') AS n FROM {_in(_DEPS, 'd(agent, test_id, e, f, role, rk)')} JOIN ({_DIFF}) c ON d.e = c.element_id AND d.f = c.facet GROUP BY 1, 2) d ON r.agent = d.agent AND r.test_id = d.test_id WHERE r.was <> r.now")
def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = lineage.diff(_elements(spark, _BEFORE), _elements(spark, _AFTER))
    frame = lambda i: spark.createDataFrame([(r[0], r[1], r[i]) for r in _RESULTS], "agent string, test_id string, status string")
    truth = spark.createDataFrame([("finance", "t3")], "agent string, test_id string")
    return lineage.verdicts(frame(2), frame(3), _deps(spark), changes, truth, False).select("agent", "test_id", "was", "now", "direction", "cause")


_RULES = [(0, "model:core", None, "core"), (1, "model:*", None, "models"), (2, "model:core", "views/ord*", "orders"), (3, "truth:*", None, "qa"), (4, "model:*", None, "models2")]
_THINGS = [("model:core", "views/orders.lkml"), ("model:core", "views/x.lkml"), ("model:other", "a.lkml"), ("truth:1", "q.sql"), ("spec:9", "s.md")]


@register("owner_resolution", f"SELECT input_id, path, COALESCE(team, 'unassigned') AS team FROM (SELECT t.input_id, t.path, r.team, row_number() OVER (PARTITION BY t.input_id, t.path ORDER BY (r.pg IS NOT NULL) DESC, length(replace(r.ig || COALESCE(r.pg, ''), '*', '')) DESC, r.idx DESC) AS n FROM {_in(_THINGS, 't(input_id, path)')} LEFT JOIN {_in(_RULES, 'r(idx, ig, pg, team)')} ON t.input_id GLOB r.ig AND t.path GLOB COALESCE(r.pg, '*')) WHERE n = 1")
def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "idx int, input_glob string, path_glob string, team string")
    return lineage.owners(spark.createDataFrame(_THINGS, "input_id string, path string"), rules)


@register("safe_ratio", "SELECT c_mktsegment, CAST(SUM(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(CAST(SUM(CASE WHEN c_acctbal > 1e12 THEN 1 ELSE 0 END) AS DOUBLE), 0) AS r FROM customer GROUP BY 1")
def _safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Registry(spark, sf_dir).table("customer")
    return c.groupBy("c_mktsegment").agg(ratio(F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)), F.sum(F.when(F.col("c_acctbal") > 1e12, 1).otherwise(0))).alias("r"))


# -- lint over the model's metadata


@register("lint_model")
def _lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.run(spark, {"retail": retail()}, spark.createDataFrame([], lint.TERMS))


for _rule in ("pii_untagged", "ambiguous_measure", "synonym_collision"):
    register(f"lint_{_rule}", lint.EXAMPLES[_rule][1])(lambda spark, sf_dir, rule=_rule: lint.example(spark, rule))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
