"""Semantic queries to DataFrames.

A query names an explore, fields and filters. The planner expands the fields'
SQL over aliased tables, joins only what is used, adds the explore's guard,
refuses measures that a join would multiply, and leaves the rest to Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspark.plans.model import TIMEFRAMES, Part, SemanticModel

_REF = re.compile(r"\$\{([^}]+)\}")
_JOINS = {"left_outer": "left", "inner": "inner", "full_outer": "full", "cross": "cross"}
_MULTIPLIES = ("one_to_many", "many_to_many")


class SemanticError(ValueError):
    """A query that the model does not allow."""


@dataclass(frozen=True)
class Filter:
    """Values of a field (``-x`` excludes x), or a half-open window of dates."""

    field: str
    values: tuple[str, ...] = ()
    start: date | None = None
    end: date | None = None


@dataclass(frozen=True)
class SemanticQuery:
    explore: str
    fields: tuple[str, ...]
    filters: tuple[Filter, ...] = ()
    sorts: tuple[str, ...] = ()  # "field" or "field desc"
    limit: int | None = None
    pivots: tuple[str, ...] = ()
    guarded: bool = True
    defaults: bool = True  # the explore's default filters, unless a filter on the field is given


@dataclass(frozen=True)
class Ref:
    alias: str
    part: Part
    frame: str = ""

    @property
    def name(self) -> str:
        return f"{self.alias}.{self.part.name}" + (f"_{self.frame}" if self.frame else "")

    @property
    def column(self) -> str:
        return self.name.replace(".", "__")


@dataclass
class Plan:
    """What a query came to: the frame, its columns and the joined aliases."""

    frame: DataFrame
    columns: list[str]
    aliases: list[str]
    measures: list[str] = field(default_factory=list)


class Planner:
    def __init__(self, model: SemanticModel, table: Callable[[str], DataFrame], derived: Callable[[str], DataFrame], grants: dict[str, bool] | None = None):
        """``table`` reads a table by name, ``derived`` runs a derived table's
        SQL; ``grants``, if given, hides fields whose required grants are not true."""
        self.model, self.table, self.derived, self.grants = model, table, derived, grants

    def plan(self, query: SemanticQuery) -> Plan:
        if query.explore not in self.model.explores:
            raise SemanticError(f"unknown explore '{query.explore}'")
        explore = self.model.explores[query.explore]
        out = _Build(self, explore).run(query)
        multiplied = any(explore.parts[a].get("relationship", "many_to_one") in _MULTIPLIES for a in out.aliases[1:])
        # Where no join repeats the base's rows, its keys need not be made distinct.
        return out if multiplied or not out.measures else _Build(self, explore, unique=True).run(query)

    def frame(self, query: SemanticQuery) -> DataFrame:
        return self.plan(query).frame

    def distinct_values(self, explore: str, name: str) -> DataFrame:
        """Values of a field, as a query of nothing else."""
        return self.frame(SemanticQuery(explore, (name,)))


class _Build:
    def __init__(self, planner: Planner, explore: Part, unique: bool = False):
        self.planner, self.model, self.explore, self.unique = planner, planner.model, explore, unique
        self.views = self.model.aliases(explore)
        self.base = next(iter(self.views))
        for alias, view in self.views.items():
            if view not in self.model.views:
                raise SemanticError(f"explore '{explore.name}': view '{view}' of '{alias}' is unknown")
        self.used = {self.base}

    # -- names

    def resolve(self, name: str, current: str) -> Ref:
        alias, _, own = name.rpartition(".")
        alias = alias or current
        if alias not in self.views:
            if alias == self.views.get(current):  # the view's own name under a role
                alias = current
            else:
                raise SemanticError(f"unknown view '{alias}' in explore '{self.explore.name}'")
        parts = self.model.views[self.views[alias]].parts
        if own in parts:
            part, frame = parts[own], ""
            if part.kind == "dimension_group":
                frame = "raw"
        else:
            group, _, frame = own.rpartition("_")
            part = parts.get(group)
            frames = part.get("timeframes", list(TIMEFRAMES)) if part else []
            if part is None or part.kind != "dimension_group" or frame not in TIMEFRAMES or frame not in [*frames, "raw"]:
                raise SemanticError(f"unknown field '{alias}.{own}' in explore '{self.explore.name}'")
        needed = part.get("required_access_grants", [])
        if self.planner.grants is not None and not all(self.planner.grants.get(g) for g in needed):  # type: ignore[union-attr]
            raise SemanticError(f"field '{alias}.{own}' needs grants {needed}")
        return Ref(alias, part, frame)

    # -- expressions

    def _expand(self, sql: str, alias: str, stack: tuple[str, ...], measures: bool) -> str:
        def one(m: re.Match) -> str:
            if m[1] == "TABLE":
                self.used.add(alias)
                return alias
            ref = self.resolve(m[1].strip(), alias)
            if ref.name in stack:
                raise SemanticError("circular reference: " + " -> ".join([*stack, ref.name]))
            if ref.part.kind == "measure":
                if not measures:
                    raise SemanticError(f"dimension refers to measure '{ref.name}'")
                key = f"__m{len(self.inner)}"
                self.inner[key] = self.measure(ref, (*stack, ref.name))
                return key
            return f"({self.dimension_sql(ref, stack)})"

        return _REF.sub(one, sql)

    def dimension_sql(self, ref: Ref, stack: tuple[str, ...] = ()) -> str:
        self.used.add(ref.alias)
        sql = str(ref.part.get("sql") or "${TABLE}." + ref.part.name)
        out = self._expand(sql, ref.alias, (*stack, ref.name), False)
        if ref.frame:
            at = {
                "raw": "{x}", "time": "{x}", "date": "CAST({x} AS DATE)", "week": "CAST(date_trunc('WEEK', {x}) AS DATE)", "month": "date_format({x}, 'yyyy-MM')",
                "quarter": "concat(CAST(year({x}) AS STRING), '-Q', CAST(quarter({x}) AS STRING))", "year": "year({x})",
            }[ref.frame]
            if ref.part.get("datatype") == "date":
                out = f"CAST({out} AS DATE)"
            out = at.format(x=f"({out})")
        return out

    def dimension(self, ref: Ref) -> Column:
        return F.expr(self.dimension_sql(ref))

    def condition(self, ref: Ref, values: tuple[str, ...]) -> Column:
        if not values:
            raise SemanticError(f"filter on '{ref.name}' has no values")
        c = self.dimension(ref)
        if ref.part.type == "yesno":
            known = F.coalesce(c, F.lit(False))
            out = None
            for v in values:
                if v.lower() not in ("yes", "no"):
                    raise SemanticError(f"filter on yes/no field '{ref.name}' takes yes or no, not '{v}'")
                one = known if v.lower() == "yes" else ~known
                out = one if out is None else out | one
            return out
        # Literals take the column's kind, not the column theirs, so that the filter reaches the scan.
        number = lambda v: int(v) if re.fullmatch(r"[+-]?\d+", v.strip()) else float(v)
        lit = lambda v: F.lit(number(v) if ref.part.type == "number" else v)
        yes = [lit(v) for v in values if not v.startswith("-")]
        no = [lit(v[1:]) for v in values if v.startswith("-")]
        out = c.isin(*yes) if yes else None
        if no:
            out = ~c.isin(*no) if out is None else out & ~c.isin(*no)
        return out

    def _check_fan_out(self, ref: Ref, kind: str) -> None:
        """Joins that multiply the measure's rows are refused, unless the
        aggregate does not mind repeats."""
        if kind in ("min", "max", "count_distinct") or (kind == "count" and self._key(ref) is not None):
            return
        self.guarded_measures.append(ref)

    def _key(self, ref: Ref) -> Part | None:
        return next((p for p in self.model.views[self.views[ref.alias]].parts.values() if p.yes("primary_key")), None)

    def measure(self, ref: Ref, stack: tuple[str, ...]) -> Column:
        part, kind, self_name = ref.part, ref.part.type, ref.name
        if kind == "number":
            if part.filters:
                raise SemanticError(f"number measure '{self_name}' can't have filters")
            if not part.get("sql"):
                raise SemanticError(f"measure '{self_name}' has no sql")
            outer, self.inner = self.inner, {}
            text = self._expand(str(part.get("sql")), ref.alias, stack, True)
            made, self.inner = self.inner, outer
            for k, c in made.items():
                name = f"__v{len(self.values)}"
                self.values[name] = c
                text = re.sub(rf"\b{k}\b", name, text)
            return F.expr(text)
        self.used.add(ref.alias)
        self._check_fan_out(ref, kind)
        when = None
        for name, value in part.filters:
            one = self.condition(self.resolve(name, ref.alias), tuple(v.strip() for v in str(value).split(",")))
            when = one if when is None else when & one
        only = lambda c: F.when(when, c) if when is not None else c
        if kind == "count":
            key = self._key(ref)
            if key is None:
                return F.count(only(F.lit(1)))
            counted = F.count if self.unique and ref.alias == self.base else F.count_distinct
            return counted(only(self.dimension(Ref(ref.alias, key))))
        makers = {"count_distinct": F.count_distinct, "sum": F.sum, "average": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max}
        if kind not in makers:
            raise SemanticError(f"measure '{self_name}' has unsupported type '{kind}'")
        if not part.get("sql"):
            raise SemanticError(f"measure '{self_name}' has no sql")
        return makers[kind](only(F.expr(self._expand(str(part.get("sql")), ref.alias, stack, False))))

    # -- the plan

    def run(self, q: SemanticQuery) -> Plan:
        if q.pivots:
            raise SemanticError("pivots are not supported")
        self.values: dict[str, Column] = {}
        self.inner: dict[str, Column] = {}
        self.guarded_measures: list[Ref] = []
        refs = [self.resolve(f, self.base) for f in q.fields]
        dims = [r for r in refs if r.part.kind != "measure"]
        measures = [r for r in refs if r.part.kind == "measure"]
        if not refs:
            raise SemanticError("a query needs a field")
        shown = [(F.when(self.dimension(r), "Yes").otherwise("No") if r.part.type == "yesno" else self.dimension(r)).alias(r.column) for r in dims]
        after: dict[str, Column] = {}
        direct: dict[str, Column] = {}
        for r in measures:
            c = self.measure(r, (r.name,))
            (after if r.part.type == "number" else direct)[r.column] = c
        where: list[Column] = []
        if q.guarded and self.explore.get("sql_always_where"):
            where.append(F.expr(self._expand(str(self.explore.get("sql_always_where")), self.base, (), False)))
        having: list[tuple[Ref, Filter]] = []
        filters = list(q.filters)
        if q.defaults:
            given = {self.resolve(f.field, self.base).name for f in filters}
            for name, value in sorted(self.explore.get("always_filter", [])):  # type: ignore[arg-type]
                if self.resolve(name, self.base).name not in given:
                    filters.insert(0, Filter(name, tuple(v.strip() for v in str(value).split(","))))
        for f in filters:
            ref = self.resolve(f.field, self.base)
            if ref.part.kind == "measure":
                having.append((ref, f))
                if ref.column not in after and ref.column not in direct:
                    (after if ref.part.type == "number" else direct)[ref.column] = self.measure(ref, (ref.name,))
            elif f.start or f.end:
                raw = Ref(ref.alias, ref.part, "raw") if ref.part.kind == "dimension_group" else ref
                c = self.dimension(raw)
                # The raw column is compared with literals, so that the window reaches the scan.
                if f.start:
                    where.append(c >= F.lit(f.start))
                if f.end:
                    where.append(c < F.lit(f.end))
            else:
                where.append(self.condition(ref, f.values))
        frame, aliases = self._joined()
        for c in where:
            frame = frame.where(c)
        if measures or having:
            made = [c.alias(n) for n, c in (direct | self.values).items()]
            frame = frame.groupBy(*shown).agg(*(made or [F.count(F.lit(1)).alias("__n")]))
            frame = frame.select(*[r.column for r in dims], *[n for n in direct], *[c.alias(n) for n, c in after.items()])
        else:
            frame = frame.select(*shown).distinct()
        for ref, f in having:
            frame = frame.where(self._having(F.col(ref.column), f))
        frame = frame.select(*[r.column for r in [*dims, *measures]])
        return Plan(self._ordered(frame, q, dims), [r.name for r in [*dims, *measures]], aliases, [r.name for r in measures])

    @staticmethod
    def _having(c: Column, f: Filter) -> Column:
        out = None
        for v in f.values:
            m = re.fullmatch(r"(>=|<=|<>|>|<|=)?\s*(-?[\d.]+)", v.strip())
            if not m:
                raise SemanticError(f"filter on measure '{f.field}' takes comparisons with numbers, not '{v}'")
            x = F.lit(float(m[2]))
            one = {">=": c >= x, "<=": c <= x, "<>": c != x, ">": c > x, "<": c < x, "=": c == x, None: c == x}[m[1]]
            out = one if out is None else out & one
        if out is None:
            raise SemanticError(f"filter on '{f.field}' has no values")
        return out

    def _ordered(self, frame: DataFrame, q: SemanticQuery, dims: list[Ref]) -> DataFrame:
        if q.sorts:
            keys = []
            for s in q.sorts:
                name, _, way = s.partition(" ")
                c = F.col(self.resolve(name, self.base).column)
                keys.append(c.desc_nulls_last() if way.strip().lower() == "desc" else c.asc_nulls_last())
            frame = frame.orderBy(*keys)
        elif dims and q.limit is None:
            frame = frame.orderBy(*[F.col(r.column).asc_nulls_last() for r in dims])
        return frame.limit(q.limit) if q.limit is not None else frame

    def _source(self, alias: str) -> DataFrame:
        view = self.model.views[self.views[alias]]
        if view.get("derived_sql"):
            return self.planner.derived(str(view.get("derived_sql"))).alias(alias)
        if view.get("sql_table_name"):
            return self.planner.table(str(view.get("sql_table_name"))).alias(alias)
        raise SemanticError(f"view '{view.name}' has neither a table nor a derived table")

    def _joined(self) -> tuple[DataFrame, list[str]]:
        """The base and the used joins, in declared order, with those that their
        conditions need."""
        joins = self.explore.parts
        on: dict[str, str] = {}
        while missing := [a for a in self.used if a != self.base and a not in on]:
            for a in missing:
                sql, kind = joins[a].get("sql_on"), joins[a].get("type", "left_outer")
                if kind not in _JOINS:
                    raise SemanticError(f"join '{a}' has unknown type '{kind}'")
                if not sql and kind != "cross":
                    raise SemanticError(f"join '{a}' has no sql_on")
                on[a] = self._expand(str(sql), a, (), False) if sql else ""
                self.used.add(a)
        order = [a for a in joins if a in on]
        for ref in self.guarded_measures:
            # A multiplying join repeats the rows of the others; its own measures are refused too,
            # since a later join to its rows can't be told apart from one to the base's.
            bad = [a for a in order if joins[a].get("relationship", "many_to_one") in _MULTIPLIES]
            if bad:
                raise SemanticError(f"measure '{ref.name}' would be multiplied by join '{bad[0]}'")
        frame = self._source(self.base)
        for a in order:
            how = _JOINS[str(joins[a].get("type", "left_outer"))]
            other = self._source(a)
            frame = frame.crossJoin(other) if how == "cross" else frame.join(other, F.expr(on[a]), how)
        return frame, [self.base, *order]
