"""Lint rules as queries over frames of a model's metadata.

``fields``: one row per field; ``explores``, ``joins`` and ``terms`` likewise.
Each rule is a query that returns rule, location, object and message; the run
joins severities, drops exemptions and repeats, and sorts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.plans.model import SemanticModel

FIELDS = "project string, view string, name string, kind string, type string, label string, description string, sql string, hidden boolean, tags array<string>, grants array<string>, origin string, op string, location string, exempt array<string>, format string, filters string"
EXPLORES = "project string, explore string, description string, guard string, tags array<string>, required boolean, location string"
JOINS = "project string, explore string, alias string, view string"
TERMS = "term_id string, name string, status string, synonyms array<string>, linked_fields array<string>"
GRANTS = "project string, name string"

# Names that look like personal data.
PII = r"(?i)(^|_)(email|e_mail|phone|mobile|ssn|birth|dob|address|first_name|last_name|contact|full_name|passport)(_|$)"
#: Most queryable fields of an explore.
SURFACE = 150
#: Rules by name with their severity.
SEVERITY = {
    "LNT000": "error", "LNT001": "warning", "LNT002": "warning", "LNT003": "error", "LNT004": "error", "LNT005": "error", "LNT006": "warning", "LNT007": "error",
    "LNT008": "error", "LNT009": "note", "LNT010": "warning", "LNT011": "error", "LNT012": "warning", "LNT013": "warning", "LNT014": "warning",
    "LNT015": "error", "LNT016": "warning", "LNT017": "warning", "LNT018": "error",
}


def metadata(spark: SparkSession, models: dict[str, SemanticModel]) -> dict[str, DataFrame]:
    """Frames of the metadata of resolved models."""
    fields, explores, joins, grants, problems = [], [], [], [], []
    for project, m in models.items():
        problems += [(project, p) for p in m.problems]
        grants += [(project, g) for g in m.grants]
        for v in m.views.values():
            for f in v.parts.values():
                fields.append((
                    project, v.name, f.name, f.kind, f.type, f.get("label"), f.get("description"), f.get("sql"), f.yes("hidden"), f.tags,
                    list(f.get("required_access_grants", [])), f.first.project, f.history[-1][0], str(f.last), sorted(f.exempt),
                    f.get("value_format_name") or f.get("value_format"), str(sorted(f.get("filters") or [])),
                ))
        for e in m.explores.values():
            explores.append((project, e.name, e.get("description"), e.get("sql_always_where"), e.tags, e.get("extension") == "required", str(e.last)))
            joins += [(project, e.name, a, v) for a, v in m.aliases(e).items()]
    return {
        "fields": spark.createDataFrame(fields, FIELDS), "explores": spark.createDataFrame(explores, EXPLORES), "joins": spark.createDataFrame(joins, JOINS),
        "grants": spark.createDataFrame(grants, GRANTS), "problems": spark.createDataFrame(problems, "project string, problem string"),
    }


def _found(df: DataFrame, rule: str, thing: Column, message: str | Column) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    exempt = F.col("exempt") if "exempt" in df.columns else F.array().cast("array<string>")
    return df.select(F.lit(rule).alias("rule"), F.col("location"), thing.alias("object"), text.alias("message"), exempt.alias("exempt"))


def _field() -> Column:
    return F.concat_ws(".", "view", "name")


def _tag(prefix: str) -> Column:
    """Tags that begin with a prefix, without it."""
    return F.transform(F.filter("tags", lambda t: t.startswith(prefix)), lambda t: F.substring(t, F.lit(len(prefix) + 1), F.length(t)))


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def pii_untagged(fields: DataFrame) -> DataFrame:
    """Dimensions with names of personal data and no pii tag."""
    return fields.where((F.col("kind") == "dimension") & F.col("name").rlike(PII) & ~F.array_contains("tags", "pii"))


def ambiguous_measures(fields: DataFrame) -> DataFrame:
    """Measures of one name with several definitions, filters included, in all
    projects together."""
    m = fields.where("kind = 'measure'").withColumn("definition", F.concat_ws("|", "type", F.regexp_replace(F.coalesce("sql", F.lit("")), r"\s+", " "), "filters"))
    many = m.groupBy("name").agg(F.count_distinct("definition").alias("definitions")).where("definitions > 1")
    return m.join(many, "name")


def synonym_collisions(terms: DataFrame) -> DataFrame:
    """Names and synonyms that several terms claim."""
    said = terms.select("term_id", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("s"))
    said = said.select("term_id", F.lower(F.trim("s")).alias("phrase")).distinct()
    return said.groupBy("phrase").agg(F.count(F.lit(1)).alias("terms"), F.array_join(F.array_sort(F.collect_list("term_id")), ",").alias("claimed_by")).where("terms > 1")


def run(spark: SparkSession, models: dict[str, SemanticModel], terms: DataFrame, severity: dict[str, str] | None = None, guard: str = "in_debt|is_test_account") -> DataFrame:
    """All findings: rule, severity, location, object and message, in order.
    ``severity`` overrides those of rules; ``off`` silences one."""
    d = metadata(spark, models)
    fields, explores, joins = d["fields"], d["explores"], d["joins"]
    shown = fields.where("NOT hidden")
    asked = explores.where("NOT required")
    links = terms.select("term_id", "status", F.explode_outer("linked_fields").alias("linked"))
    approved = terms.where("status = 'approved'").select("term_id")
    tagged = fields.select("*", F.explode(_tag("glossary:")).alias("term_id"))
    curated = shown.where(F.array_contains("tags", "ai_exposed"))
    # Terms reach fields by tags, and by the links of the terms.
    by_link = links.where("linked IS NOT NULL").join(fields.select("project", "view", "name", _field().alias("linked")), "linked")
    linked = by_link.select("project", "view", "name").distinct()
    termed = tagged.join(approved, "term_id").select("project", "view", "name").unionByName(by_link.where("status = 'approved'").select("project", "view", "name")).distinct()
    reach = asked.select("project", "explore", "location").join(joins, ["project", "explore"]).join(shown.select("project", "view", "name", "kind", F.col("type").alias("t"), F.col("tags").alias("ftags")), ["project", "view"])
    found: list[DataFrame] = [
        d["problems"].select(F.lit("LNT000").alias("rule"), F.col("project").alias("location"), F.col("project").alias("object"), F.col("problem").alias("message"), F.array().cast("array<string>").alias("exempt")),
        _found(shown.where(blank("description")), "LNT001", _field(), "has no description"),
        _found(curated.where(blank("label")), "LNT002", _field(), "is curated for agents and has no label"),
        _found(curated.join(termed, ["project", "view", "name"], "left_anti"), "LNT003", _field(), "is curated for agents and has no approved term"),
        _found(pii_untagged(fields), "LNT004", _field(), "looks like personal data and isn't tagged pii"),
        _found(fields.where(F.array_contains("tags", "pii") & ~F.col("hidden") & (F.size("grants") == 0)), "LNT005", _field(), "personal data without an access grant"),
        _found(ambiguous_measures(fields), "LNT006", _field(), F.concat(F.col("definitions").cast("string"), F.lit(" definitions of this measure"))),
        _found(_redefined(fields), "LNT007", _field(), "an importing project redefines a certified measure"),
        _found(asked.join(joins.join(fields.where(F.col("name").rlike(guard)).select("project", "view").distinct(), ["project", "view"]).select("project", "explore").distinct(), ["project", "explore"]).where(~F.coalesce(F.col("guard"), F.lit("")).rlike(guard)), "LNT008", F.col("explore"), "has no guard against test accounts"),
        _found(shown.where("kind = 'measure'").where(blank("format")), "LNT009", _field(), "a measure without a value format"),
        _found(asked.where(F.array_contains("tags", "fiscal_reporting")).join(joins.where("view LIKE '%fiscal%'").select("project", "explore"), ["project", "explore"], "left_anti"), "LNT010", F.col("explore"), "reports by fiscal periods without a fiscal calendar"),
        links.where("linked IS NOT NULL").join(fields.select(_field().alias("linked")).distinct(), "linked", "left_anti").select(F.lit("LNT011").alias("rule"), F.concat(F.lit("term:"), "term_id").alias("location"), F.col("linked").alias("object"), F.lit("a term links to a field that isn't there").alias("message"), F.array().cast("array<string>").alias("exempt")),
        _found(reach.groupBy("project", "explore", "location").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SURFACE), "LNT012", F.col("explore"), F.concat(F.col("n").cast("string"), F.lit(" fields can be queried"))),
        _found(fields.where(F.array_contains("tags", "ai_exposed") & (F.col("hidden") | F.array_contains("tags", "ai_hidden"))), "LNT013", _field(), "is both curated for agents and hidden from them"),
        _found(shown.where("kind = 'measure'").where(F.array_contains("tags", "certified")).join(linked, ["project", "view", "name"], "left_anti").where(F.size(_tag("glossary:")) == 0), "LNT014", _field(), "a certified measure without a term"),
        synonym_collisions(terms).select(F.lit("LNT015").alias("rule"), F.lit("terms").alias("location"), F.col("phrase").alias("object"), F.concat(F.lit("claimed by "), "claimed_by").alias("message"), F.array().cast("array<string>").alias("exempt")),
        _found(asked.where(blank("description")), "LNT016", F.col("explore"), "has no description"),
        _found(tagged.join(terms.select("term_id"), "term_id", "left_anti"), "LNT017", _field(), F.concat(F.lit("unknown term: "), F.col("term_id"))),
        _found(fields.select("*", F.explode("grants").alias("g")).join(d["grants"].withColumnRenamed("name", "g"), ["project", "g"], "left_anti"), "LNT018", _field(), F.concat(F.lit("undefined grant: "), F.col("g"))),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    levels = spark.createDataFrame(list((SEVERITY | (severity or {})).items()), "rule string, severity string")
    kept = every.where(~F.array_contains("exempt", F.col("rule"))).join(F.broadcast(levels), "rule").where("severity <> 'off'")
    return kept.select("rule", "severity", "location", "object", "message").distinct().orderBy("location", "rule", "object", "message")


def _redefined(fields: DataFrame) -> DataFrame:
    home = fields.where("project = origin AND kind = 'measure'").where(F.array_contains("tags", "certified")).select(F.col("origin"), "view", "name", F.col("sql").alias("was"), F.col("type").alias("t"), F.col("filters").alias("kept"))
    return fields.where("project <> origin").join(home, ["origin", "view", "name"]).where(~(F.col("sql").eqNullSafe(F.col("was")) & (F.col("type") == F.col("t")) & F.col("filters").eqNullSafe(F.col("kept"))))


_F = [("p", "customers", "email", "dimension", "string", "a", []), ("p", "customers", "phone_no", "dimension", "string", "b", ["pii"]), ("p", "orders", "revenue", "measure", "sum", "x", []), ("p", "lines", "revenue", "measure", "sum", "y", []), ("p", "orders", "n", "measure", "count", None, [])]
_T = [("rev", "Revenue", ["sales", "turnover"]), ("bookings", "Bookings", ["Sales "]), ("orders", "Orders", [])]
_FV = ", ".join(f"('{v}', '{n}', '{k}', '{t}', {'NULL' if s is None else repr(s)}, {int('pii' in g)})" for _, v, n, k, t, s, g in _F)
_TV = ", ".join(f"('{t}', '{p}')" for t, n, syn in _T for p in [n, *syn])
#: Small frames for the rules that stand on their own, with oracles.
EXAMPLES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "pii_untagged": (lambda d: pii_untagged(d).select("view", "name"), f"SELECT view, name FROM (VALUES {_FV}) t(view, name, kind, type, sql, pii) WHERE kind = 'dimension' AND pii = 0 AND regexp_matches(name, '(^|_)(email|phone)(_|$)')"),
    "ambiguous_measure": (lambda d: ambiguous_measures(d).select("view", "name", "definitions"), f"SELECT view, name, definitions FROM (VALUES {_FV}) t(view, name, kind, type, sql, pii) JOIN (SELECT name, COUNT(DISTINCT type || '|' || COALESCE(sql, '')) AS definitions FROM (VALUES {_FV}) u(view, name, kind, type, sql, pii) WHERE kind = 'measure' GROUP BY 1 HAVING COUNT(DISTINCT type || '|' || COALESCE(sql, '')) > 1) d USING (name) WHERE kind = 'measure'"),
    "synonym_collision": (lambda d: synonym_collisions(d), f"SELECT phrase, COUNT(*) AS terms, string_agg(t, ',' ORDER BY t) AS claimed_by FROM (SELECT DISTINCT t, lower(trim(p)) AS phrase FROM (VALUES {_TV}) v(t, p)) GROUP BY 1 HAVING COUNT(*) > 1"),
}


def example(spark: SparkSession, rule: str) -> DataFrame:
    """One rule over its small frame."""
    if rule == "synonym_collision":
        frame = spark.createDataFrame([(t, n, "approved", s, []) for t, n, s in _T], TERMS)
    else:
        frame = spark.createDataFrame([(p, v, n, k, t, n, "", s, False, g, [], p, "define", "f:1", [], "usd", "[]") for p, v, n, k, t, s, g in _F], FIELDS)
    return EXAMPLES[rule][0](frame)
