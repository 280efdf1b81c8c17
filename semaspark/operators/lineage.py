"""Lineage: snapshots of model elements, their differences, what these touch,
why results changed, and who owns the cause. All are joins and aggregates."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semaspark.functions.scalar import short_value
from semaspark.plans.model import Part, SemanticModel

# Parameters that change results; all others change what is shown.
FIELD_SEMANTIC = ("sql", "type", "filters", "primary_key", "datatype", "timeframes", "convert_tz")
EXPLORE_SEMANTIC = ("sql_always_where", "always_filter", "view_name", "from", "extends")
#: The first of these that a facet has tells where the facet is written.
LEADS = ("sql", "sql_always_where", "type")
ROLES = {"queried": 0, "guard": 1, "referenced": 2, "context": 3, "truth": 4}

ELEMENTS = "element_id string, kind string, facet string, version string, input_id string, location string, params map<string,string>"


def _version(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def model_version(model: SemanticModel) -> str:
    """One hash over all that the views and explores of a model say."""
    said = {f"{k}:{p.name}": [p.params, {n: f.params for n, f in p.parts.items()}] for k, parts in (("view", model.views), ("explore", model.explores)) for p in parts.values()}
    return _version(said)


def _facets(part: Part, semantic: tuple[str, ...]) -> list[tuple[str, dict, Part]]:
    known = {k: v for k, v in part.params.items()}
    yes = {k: v for k, v in known.items() if k in semantic}
    return [("semantic", yes, part), ("surface", {k: v for k, v in known.items() if k not in semantic}, part)]


def snapshot(spark: SparkSession, model: SemanticModel) -> DataFrame:
    """Elements of a model, a row for each facet, with parameters and places."""
    rows = []

    def add(ident: str, kind: str, facets: list[tuple[str, dict, Part]]) -> None:
        for facet, params, part in facets:
            lead = next((k for k in LEADS if k in params), None)
            place = part.places.get(lead, part.last) if lead else part.last
            text = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str) for k, v in params.items()}
            rows.append((ident, kind, facet, _version(params), f"model:{place.project}", f"{place.file}:{place.line}", text))

    for v in model.views.values():
        add(f"view:{v.name}", "view", [("content", {k: x for k, x in v.params.items() if k in ("sql_table_name", "derived_sql")}, v)])
        for f in v.parts.values():
            add(f"field:{v.name}.{f.name}", "field", _facets(f, FIELD_SEMANTIC))
    for e in model.explores.values():
        add(f"explore:{e.name}", "explore", _facets(e, EXPLORE_SEMANTIC))
        for j in e.parts.values():
            add(f"join:{e.name}.{j.name}", "join", [("content", j.params, j)])
    out = spark.createDataFrame(rows, ELEMENTS)
    return out.withColumn("params", F.transform_values("params", lambda _, v: short_value(v)))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed facets of two snapshots: change (added, removed, modified), the
    later input and place, and the parameters that differ."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, (F.col("a.element_id") == F.col("b.element_id")) & (F.col("a.facet") == F.col("b.facet")), "full")
    both = both.where(~F.col("a.version").eqNullSafe(F.col("b.version")))
    of = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    empty = F.create_map().cast("map<string,string>")
    x, y = F.coalesce(F.col("a.params"), empty), F.coalesce(F.col("b.params"), empty)
    changed = F.filter(F.array_sort(F.array_distinct(F.concat(F.map_keys(x), F.map_keys(y)))), lambda k: ~F.element_at(x, k).eqNullSafe(F.element_at(y, k)))
    change = F.when(F.col("a.element_id").isNull(), "added").when(F.col("b.element_id").isNull(), "removed").otherwise("modified")
    return both.select(of("element_id").alias("element_id"), of("kind").alias("kind"), of("facet").alias("facet"), change.alias("change"), of("input_id").alias("input_id"), of("location").alias("location"), changed.alias("params"))


def references(model: SemanticModel) -> dict[str, set[str]]:
    """Fields that each field's SQL and filters name, views resolved."""
    out: dict[str, set[str]] = {}
    for v in model.views.values():
        for f in v.parts.values():
            names = re.findall(r"\$\{([^}]+)\}", str(f.get("sql", ""))) + [k for k, _ in f.filters]
            found = set()
            for n in names:
                view, _, own = n.rpartition(".")
                view = view or v.name
                parts = model.views[view].parts if view in model.views else {}
                if own not in parts and "_" in own and own.rpartition("_")[0] in parts:
                    own = own.rpartition("_")[0]
                if own in parts:
                    found.add(f"field:{view}.{own}")
            out[f"field:{v.name}.{f.name}"] = found
    return out


def closure(edges: dict[str, set[str]], start: set[str]) -> set[str]:
    """All that can be reached from some fields."""
    seen, todo = set(), list(start)
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += edges.get(x, ())
    return seen


def dependencies(raw: DataFrame) -> DataFrame:
    """One row per test and element of raw uses (agent, test_id, element_id,
    facet, role, rank): the closest role, and all facets."""
    return raw.groupBy("agent", "test_id", "element_id").agg(F.min("rank").alias("rank"), F.min_by("role", F.struct("rank", "role")).alias("role"), F.array_sort(F.collect_set("facet")).alias("facets"))


def model_dependencies(spark: SparkSession, model: SemanticModel, tests: list[dict]) -> DataFrame:
    """Raw uses of tests ({agent, test_id, explore, fields, checked}): queried
    fields, the fields behind them, the explore, its guard and its joins. Tests
    whose rows aren't checked depend on what is shown only."""
    edges, rows = references(model), []
    for t in tests:
        explore = model.explores[t["explore"]]
        views = model.aliases(explore)
        facets = ("semantic", "surface") if t["checked"] else ("surface",)

        def ident(name: str, views: dict[str, str] = views) -> str:
            alias, _, own = name.rpartition(".")
            view = views.get(alias, alias or next(iter(views.values())))
            parts = model.views[view].parts
            return f"field:{view}.{own if own in parts else own.rpartition('_')[0]}"

        asked = {ident(n) for n in t["fields"]}
        guard = {ident(n) for n in re.findall(r"\$\{([^}]+)\}", str(explore.get("sql_always_where", "")))}
        uses = [(x, "queried") for x in asked] + [(x, "guard") for x in closure(edges, guard)] + [(x, "referenced") for x in closure(edges, asked) - asked]
        rows += [(t["agent"], t["test_id"], x, f, role, ROLES[role]) for x, role in uses for f in facets]
        rows += [(t["agent"], t["test_id"], f"explore:{explore.name}", f, "queried", 0) for f in facets]
        if t["checked"]:
            used = {views.get(n.rpartition(".")[0]) for n in t["fields"]}
            rows += [(t["agent"], t["test_id"], f"join:{explore.name}.{j}", "content", "referenced", 2) for j in explore.parts if views[j] in used]
    return spark.createDataFrame(rows, "agent string, test_id string, element_id string, facet string, role string, rank int")


def impact(deps: DataFrame, changes: DataFrame, known: DataFrame) -> DataFrame:
    """Tests that changes may touch: (agent, test_id, reason). Tests that are
    not ``known`` yet always count."""
    near = deps.where("rank < 3").select("agent", "test_id", "element_id", F.explode("facets").alias("facet"))
    hit = near.join(changes.select("element_id", "facet").distinct(), ["element_id", "facet"]).select("agent", "test_id").distinct().withColumn("reason", F.lit("changed"))
    new = deps.select("agent", "test_id").distinct().join(known.select("agent", "test_id").distinct(), ["agent", "test_id"], "left_anti")
    return hit.join(new, ["agent", "test_id"], "left_anti").unionByName(new.withColumn("reason", F.lit("new")))


def verdicts(before: DataFrame, after: DataFrame, deps: DataFrame, changes: DataFrame, truth_changed: DataFrame, runner_changed: bool) -> DataFrame:
    """Why tests' statuses changed between two runs (agent, test_id, status).

    ``input``: exactly one input among the changed dependencies; ``multiple``:
    several; ``data``: none, but the ground truth moved (``truth_changed``:
    agent, test_id); else ``external``. The likely cause is the closest changed
    element, the first by name on ties.
    """
    good = lambda c: c.isin("pass", "drift")
    moved = (
        before.select("agent", "test_id", F.col("status").alias("was")).join(after.select("agent", "test_id", F.col("status").alias("now")), ["agent", "test_id"]).where("was <> now")
        .withColumn("direction", F.when(good(F.col("was")) & ~good(F.col("now")), "regression").when(~good(F.col("was")) & good(F.col("now")), "fix").otherwise("other"))
    )
    touched = deps.select("agent", "test_id", "element_id", "rank", F.explode("facets").alias("facet")).join(changes, ["element_id", "facet"])
    w = Window.partitionBy("agent", "test_id").orderBy("rank", "element_id", "facet")
    first = touched.withColumn("r", F.row_number().over(w)).where("r = 1").select("agent", "test_id", F.col("element_id").alias("cause_element"), F.col("location").alias("cause_location"), F.col("input_id").alias("cause_input"))
    counted = touched.groupBy("agent", "test_id").agg(F.count_distinct("input_id").alias("inputs"), F.count_distinct(F.when(F.col("rank") < 3, F.col("element_id"))).alias("near"))
    out = moved.join(counted, ["agent", "test_id"], "left").join(first, ["agent", "test_id"], "left").join(truth_changed.select("agent", "test_id", F.lit(True).alias("truth")), ["agent", "test_id"], "left")
    cause = F.when(F.col("inputs") == 1, "input").when(F.col("inputs") > 1, "multiple").when(F.col("truth"), "data").otherwise("external")
    sure = (
        F.when(cause == "input", F.when(F.col("near") <= 1, "high").otherwise("medium")).when(cause == "multiple", "low").when(cause == "data", "high")
        .otherwise("high" if runner_changed else "medium")
    )
    return out.select("agent", "test_id", "was", "now", "direction", cause.alias("cause"), sure.alias("confidence"), "cause_element", "cause_location", "cause_input")


def _glob(c: Column) -> Column:
    """A glob as an anchored regular expression."""
    quoted = F.regexp_replace(c, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def owners(things: DataFrame, rules: DataFrame) -> DataFrame:
    """The team of each (input_id, path) by rules (idx, input_glob, path_glob or
    null, team): those with a path first, then the most literal characters, then
    the last; ``unassigned`` without any."""
    r = F.broadcast(rules.withColumn("i", _glob(F.col("input_glob"))).withColumn("p", _glob(F.coalesce("path_glob", F.lit("*")))).withColumn(
        "literal", F.length(F.regexp_replace(F.concat(F.col("input_glob"), F.coalesce("path_glob", F.lit(""))), r"[*?]", "")),
    ))
    base = things.select("input_id", "path").distinct()
    # Rules are a hand-written file; every thing meets each of them once.
    met = base.join(r, F.expr("input_id RLIKE i AND coalesce(path, '') RLIKE p"), "left")
    best = F.max_by("team", F.struct(F.col("path_glob").isNotNull(), "literal", "idx"))
    return met.groupBy("input_id", "path").agg(F.coalesce(best, F.lit("unassigned")).alias("team"))


def external_groups(verdict: DataFrame, tags: DataFrame, hints: DataFrame) -> DataFrame:
    """External verdicts by trap or spec tag: tests, all changes, and a hint."""
    own = verdict.where("cause = 'external'").join(tags, ["agent", "test_id"]).select("test_id", F.explode("tags").alias("tag")).where("tag LIKE 'trap:%' OR tag LIKE 'spec:%'")
    return own.groupBy("tag").agg(F.count_distinct("test_id").alias("tests")).join(hints, "tag", "left").orderBy(F.desc("tests"), "tag")


def adherence(results: DataFrame) -> DataFrame:
    """Tests and passing ones by agent and element (results with rule_ids)."""
    good = F.col("status").isin("pass", "drift")
    return results.select("agent", "status", F.explode("rule_ids").alias("element_id")).groupBy("agent", "element_id").agg(F.count(F.lit(1)).alias("tests"), F.sum(good.cast("long")).alias("passing"))


def trend(results: DataFrame, last: int = 10) -> DataFrame:
    """Pass rates by run and agent over the last runs (run_id, seq, agent, status)."""
    runs = results.select("run_id", "seq").distinct().orderBy(F.desc("seq")).limit(last)
    good = F.col("status").isin("pass", "drift")
    return results.join(runs, ["run_id", "seq"]).groupBy("run_id", "seq", "agent").agg(F.count(F.lit(1)).alias("tests"), F.sum(good.cast("long")).alias("passing"))
