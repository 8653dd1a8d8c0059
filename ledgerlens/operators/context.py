"""Filter context: measures that each see their own rows, compiled to one pass over a table.

A report cell fixes a value for every column of ``by``; slicers (``filters=``) fix more. Both together are the context a
measure is evaluated in. A measure is an expression over aggregates, and ``calculate`` changes the context of all
aggregates below it::

    total = rows()
    rate = divide(rows().calculate(only("STATUS", "SUCCESS")), total, 0.0) * 100
    share = divide(total, total.calculate(visible("CHANNEL")))        # of the selected channels
    of_all = divide(total, total.calculate(clear("CHANNEL")))         # of all channels, whatever is selected

    evaluate(model, {"rate": rate, "share": share}, by=["month", "CHANNEL"], filters={"CHANNEL": ["WEB", "APP"]})

Changes: ``only`` / ``where`` replace what is said about their columns, ``keep`` adds to it, ``clear`` drops it, ``clear_all``
and ``clear_but`` drop everything (but the named columns), ``visible`` goes back from the cell to the slicers' selection.
Outer ``calculate`` calls are applied before inner ones, so the inner one has the last word on a column.

Every aggregate thus ends as (columns of the cell that still bind it, conditions). Plan per table: conditions shared by all
go to the scan, others become conditional aggregates of one ``groupBy`` over the cells; an aggregate that fewer columns
bind is the sum (least, greatest) of the cells' parts over a window on those columns. Distinct counts do not add up, so
those at coarser grains come from grouping sets of the same pass. Members new to a column (``new_members``) reduce the
rows to one per cell and member first. So the fact is scanned once, whatever the measures.

A cell has a row if the table has a row for it under the slicers. Counts of no rows are 0, other aggregates of none NULL
(blank). A table without a ``by`` or slicer column is not bound by it. NULL is a member like any other.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import kpi
from ledgerlens.sources.star import Star

FACT = "transactions"
MONTH = "month"


# ---------------------------------------------------------------- conditions
def literal(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


@dataclass(frozen=True)
class Condition:
    """A SQL predicate and the columns it speaks about."""

    columns: tuple[str, ...]
    sql: str


def among(column: str, *values) -> Condition:
    """The column is one of the values (NULL is a value)."""
    given = [literal(v) for v in values if v is not None]
    parts = [f"`{column}` IN ({', '.join(given)})"] if given else []
    if None in values:
        parts.append(f"`{column}` IS NULL")
    return Condition((column,), "(" + (" OR ".join(parts) or "FALSE") + ")")


def between(column: str, low=None, high=None) -> Condition:
    """``low <= column <= high``; an end that is None is open."""
    ends = [f"`{column}` >= {literal(low)}"] * (low is not None) + [f"`{column}` <= {literal(high)}"] * (high is not None)
    return Condition((column,), "(" + (" AND ".join(ends) or "TRUE") + ")")


def that(sql: str, *columns: str) -> Condition:
    """Any predicate, with the columns it speaks about."""
    return Condition(columns, f"({sql})")


def as_condition(column: str, given) -> Condition:
    """A slicer's value: a Condition, a list of members or one member."""
    if isinstance(given, Condition):
        return given
    return among(column, *given) if isinstance(given, (list, tuple, set, frozenset)) else among(column, given)


# ---------------------------------------------------------------- context
@dataclass(frozen=True)
class Context:
    """What binds an aggregate: columns of the cell, slicers, and conditions of its own."""

    cell: frozenset[str]
    slicers: frozenset[Condition]
    own: frozenset[Condition]
    selection: frozenset[Condition]  # the slicers as the user set them

    def without(self, columns) -> Context:
        columns = set(columns)
        return replace(
            self, cell=self.cell - columns, slicers=frozenset(c for c in self.slicers if not columns & {*c.columns}),
            own=frozenset(c for c in self.own if not columns & {*c.columns}),
        )

    def mentioned(self) -> set[str]:
        return set(self.cell).union(*(c.columns for c in self.slicers | self.own))

    def conditions(self) -> frozenset[Condition]:
        return self.slicers | self.own


Change = Callable[[Context], Context]


def where(*conditions: Condition) -> Change:
    """The conditions take the place of all that is said about their columns."""
    columns = {c for x in conditions for c in x.columns}

    def change(c: Context) -> Context:
        c = c.without(columns)
        return replace(c, own=c.own | set(conditions))

    return change


def only(column: str, *values) -> Change:
    return where(among(column, *values))


def keep(*conditions: Condition) -> Change:
    """The conditions are added to what is said already."""
    return lambda c: replace(c, own=c.own | set(conditions))


def clear(*columns: str) -> Change:
    return lambda c: c.without(columns)


def clear_all() -> Change:
    return lambda c: c.without(c.mentioned())


def clear_but(*columns: str) -> Change:
    return lambda c: c.without(c.mentioned() - set(columns))


def visible(*columns: str) -> Change:
    """From the cell's member back to all that the slicers select (all columns if none is named)."""

    def change(c: Context) -> Context:
        named = set(columns) or c.mentioned() | {x for s in c.selection for x in s.columns}
        c = c.without(named)
        return replace(c, slicers=c.slicers | {s for s in c.selection if named & {*s.columns}})

    return change


# ---------------------------------------------------------------- measures
class Measure:
    def calculate(self, *changes: Change) -> Measure:
        raise NotImplementedError

    def __add__(self, other):
        return Formula(lambda a, b: a + b, (self, _measure(other)))

    def __sub__(self, other):
        return Formula(lambda a, b: a - b, (self, _measure(other)))

    def __mul__(self, other):
        return Formula(lambda a, b: a * b, (self, _measure(other)))


@dataclass(frozen=True, eq=False)
class Aggregate(Measure):
    """One aggregate of a table's column; ``changes`` from the outermost to the innermost."""

    kind: str
    column: str | None = None
    table: str = FACT
    along: str | None = None
    changes: tuple[Change, ...] = ()

    def calculate(self, *changes: Change) -> Aggregate:
        return replace(self, changes=(*changes, *self.changes))


@dataclass(frozen=True, eq=False)
class Formula(Measure):
    """A column expression over other measures."""

    make: Callable[..., Column]
    of: tuple[Measure, ...]

    def calculate(self, *changes: Change) -> Formula:
        return replace(self, of=tuple(m.calculate(*changes) for m in self.of))


@dataclass(frozen=True, eq=False)
class Rank(Measure):
    """Dense rank of a measure, highest first, among the visible members of ``over`` in the same other cell columns."""

    measure: Measure
    over: tuple[str, ...]

    def calculate(self, *changes: Change) -> Rank:
        return replace(self, measure=self.measure.calculate(*changes))


def _measure(x) -> Measure:
    return x if isinstance(x, Measure) else Formula(lambda: F.lit(x), ())


def rows(table: str = FACT) -> Aggregate:
    return Aggregate("rows", None, table)


def total(column: str, table: str = FACT) -> Aggregate:
    return Aggregate("sum", column, table)


def least(column: str, table: str = FACT) -> Aggregate:
    return Aggregate("min", column, table)


def greatest(column: str, table: str = FACT) -> Aggregate:
    return Aggregate("max", column, table)


def mean(column: str, table: str = FACT) -> Measure:
    """Exact sum over the number of values, in DOUBLE."""
    return Formula(kpi.ratio, (total(column, table), Aggregate("values", column, table)))


def distinct(column: str, table: str = FACT, blank: bool = True) -> Aggregate:
    """Distinct members; with ``blank`` NULL counts as one."""
    return Aggregate("distinct" if blank else "known", column, table)


def new_members(column: str, along: str = MONTH, table: str = FACT) -> Aggregate:
    """Members with rows in the cell and none at an earlier value of ``along`` (a cell column), slicers on it aside."""
    return Aggregate("new", column, table, along)


def divide(a, b, other=None) -> Measure:
    """``a / b`` in DOUBLE; ``other`` where ``b`` is 0 or blank or ``a`` is blank."""
    def make(x: Column, y: Column) -> Column:
        return kpi.ratio(x, y) if other is None else F.coalesce(kpi.ratio(x, y), F.lit(other))

    return Formula(make, (_measure(a), _measure(b)))


def formula(make: Callable[..., Column], *of: Measure) -> Measure:
    return Formula(make, of)


def or_blank(count: Measure) -> Measure:
    """A count that is blank instead of 0."""
    return Formula(lambda n: F.when(n > 0, n), (count,))


def rank(measure: Measure, *over: str) -> Rank:
    return Rank(measure, over)


# ---------------------------------------------------------------- compiling
ADDS = {"rows": F.sum, "values": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Leaf:
    """An aggregate in its final context; equal ones are computed once."""

    kind: str
    column: str | None
    table: str
    along: str | None
    grain: tuple[str, ...]
    conditions: frozenset[Condition]


def _met(conditions) -> Column | None:
    given = sorted(conditions, key=lambda c: c.sql)
    return reduce(lambda a, b: a & b, (F.expr(c.sql) for c in given)) if given else None


def _part(leaf: Leaf, shared: frozenset[Condition]) -> Column:
    met = _met(leaf.conditions - shared)
    value = F.lit(1) if leaf.column is None else F.col(leaf.column)
    seen = value if met is None else F.when(met, value)
    if leaf.kind in ("rows", "values"):
        return F.count(seen)
    if leaf.kind in ("sum", "min", "max"):
        return getattr(F, leaf.kind)(seen)
    members = F.countDistinct(seen)
    if leaf.kind == "known":
        return members
    blank = value.isNull() if met is None else met & value.isNull()
    return members + F.max(F.when(blank, 1).otherwise(0))


class _Plan:
    def __init__(self, model: Model, by: list[str], selection: frozenset[Condition]):
        self.model, self.by, self.selection = model, by, selection
        self.names: dict[Leaf, str] = {}

    def leaf(self, a: Aggregate) -> Leaf:
        have = set(self.model.tables[a.table].columns)
        start = frozenset(c for c in self.selection if have >= {*c.columns})
        context = Context(frozenset(c for c in self.by if c in have), start, frozenset(), start)
        for change in a.changes:
            context = change(context)
        if a.kind == "new":
            if a.along not in context.cell:
                raise ValueError(f"new members along {a.along} need it among the columns of the cell")
            context = replace(context.without([a.along]), cell=context.cell)
            if context.cell != frozenset(c for c in self.by if c in have):
                raise ValueError("new members are counted in the cell's own grain")
        return Leaf(a.kind, a.column, a.table, a.along, tuple(c for c in self.by if c in context.cell), context.conditions())

    def collect(self, m: Measure) -> None:
        if isinstance(m, Aggregate):
            self.names.setdefault(self.leaf(m), f"_m{len(self.names)}")
        for x in m.of if isinstance(m, Formula) else (m.measure,) if isinstance(m, Rank) else ():
            self.collect(x)

    def value(self, m: Measure) -> Column:
        if isinstance(m, Aggregate):
            leaf = self.leaf(m)
            c = F.col(self.names[leaf])
            return F.coalesce(c, F.lit(0)) if leaf.kind in ("rows", "values", "distinct", "known", "new") else c
        if isinstance(m, Formula):
            return m.make(*(self.value(x) for x in m.of))
        others = [c for c in self.by if c not in m.over]
        return F.dense_rank().over(Window.partitionBy(*others).orderBy(self.value(m.measure).desc_nulls_last()))

    # -- one table
    def cells(self, table: str) -> DataFrame:
        """A row per cell: its columns, a part for each leaf, ``_seen_<table>`` rows under the slicers."""
        df = self.model.tables[table]
        by = [c for c in self.by if c in df.columns]
        leaves = {x: n for x, n in self.names.items() if x.table == table}
        start = frozenset(c for c in self.selection if set(df.columns) >= {*c.columns})
        seen = Leaf("rows", None, table, None, tuple(by), start)
        wanted = [seen, *leaves]
        shared = frozenset.intersection(*(x.conditions for x in wanted))
        if (met := _met(shared)) is not None:
            df = df.filter(met)
        rest = [x.conditions - shared for x in wanted]
        if all(rest) and len(set(rest)) > 1:  # a row that no leaf counts need not be aggregated
            df = df.filter(reduce(lambda a, b: a | b, (_met(r) for r in sorted(set(rest), key=lambda r: sorted(c.sql for c in r)))))
        aggs = [_part(seen, shared).alias(f"_seen_{table}")]
        if any(x.kind == "new" for x in leaves):
            return self._by_member(df, by, leaves, shared, aggs, table)
        wide = {x: n for x, n in leaves.items() if x.kind in ("distinct", "known") and x.grain != tuple(by)}
        aggs += [_part(x, shared).alias(n) for x, n in leaves.items()]
        if not wide:
            return df.groupBy(*by).agg(*aggs)
        grains = list(dict.fromkeys([tuple(by), *(x.grain for x in wide)]))
        ids = {g: sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in g) for g in grains}
        sets = df.groupingSets([[F.col(c) for c in g] for g in grains], *[F.col(c) for c in by]).agg(*aggs, F.grouping_id().alias("_grain"))
        for x, n in wide.items():
            held = F.max(F.when(F.col("_grain") == ids[x.grain], F.col(n))).over(Window.partitionBy(*x.grain))
            sets = sets.withColumn(n, held)
        return sets.filter(F.col("_grain") == ids[tuple(by)]).drop("_grain")

    def _by_member(self, df, by, leaves, shared, aggs, table) -> DataFrame:
        """Cells by way of one row per cell and member of the column whose new members are counted."""
        column, along = next((x.column, x.along) for x in leaves if x.kind == "new")
        for x in leaves:
            other = (x.kind == "new" and (x.column, x.along) != (column, along)) or (x.kind in ("distinct", "known") and (x.column != column or x.grain != tuple(by)))
            if other:
                raise ValueError(f"new members of {column} along {along} and {x.kind} of {x.column} need an evaluation each")
        parts, final = [aggs[0]], [F.sum(f"_seen_{table}").alias(f"_seen_{table}")]
        for x, n in leaves.items():
            if x.kind in ADDS:
                parts.append(_part(x, shared).alias(n))
                final.append(ADDS[x.kind](n).alias(n))
            else:
                met = _met(x.conditions - shared)
                parts.append(F.max(F.lit(1) if met is None else F.when(met, 1)).alias(n))
                if x.kind == "new":
                    final.append(F.count(F.when(F.col(f"{n}_first") == F.col(along), 1)).alias(n))
                else:
                    final.append(F.count(F.when(F.col("_member").isNotNull(), F.col(n)) if x.kind == "known" else F.col(n)).alias(n))
        members = df.groupBy(*by, F.col(column).alias("_member")).agg(*parts)
        w = Window.partitionBy(*[c for c in by if c != along], "_member")
        for x, n in leaves.items():
            if x.kind == "new":
                members = members.withColumn(f"{n}_first", F.min(F.when(F.col(n) == 1, F.col(along))).over(w))
        return members.groupBy(*by).agg(*final)

    def joined(self) -> DataFrame:
        tables = list(dict.fromkeys([*(x.table for x in self.names)]))
        complete = [t for t in tables if set(self.by) <= set(self.model.tables[t].columns)]
        if not complete:
            raise ValueError(f"no table has all the columns {self.by}")
        out = self.cells(complete[0])
        for t in complete[1:]:
            other = self.cells(t)
            if not self.by:  # one row each
                columns = other.columns
                row = other.select(F.struct(*columns)).scalar()
                out = out.withColumn("_row", row).select("*", *[F.col(f"_row.{c}").alias(c) for c in columns]).drop("_row")
                continue
            other = other.withColumnsRenamed({c: f"_{t}_{c}" for c in self.by})
            same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{t}_{c}")) for c in self.by))
            # a column that is NULL on one side only because the row is absent there takes the other side's
            out = out.join(other.withColumn(f"_in_{t}", F.lit(True)), same, "full")
            out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{t}_{c}")) for c in self.by}).drop(f"_in_{t}", *[f"_{t}_{c}" for c in self.by])
        for t in [t for t in tables if t not in complete]:
            on = [c for c in self.by if c in self.model.tables[t].columns]
            if not on:
                raise ValueError(f"{t} has none of the columns {self.by}")
            other = self.cells(t).withColumnsRenamed({c: f"_{t}_{c}" for c in on})
            same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{t}_{c}")) for c in on))
            out = out.join(other, same, "left").drop(*[f"_{t}_{c}" for c in on])
        for leaf, name in self.names.items():
            own = tuple(c for c in self.by if c in self.model.tables[leaf.table].columns)
            if leaf.grain == own and len(own) == len(self.by):
                continue
            if leaf.kind in ADDS and leaf.grain != own and len(own) < len(self.by):
                raise ValueError(f"an aggregate of {leaf.table} coarser than its own columns {own} needs all the columns of the cell")
            if leaf.grain != own:
                fold = ADDS.get(leaf.kind, F.max)
                out = out.withColumn(name, fold(F.col(name)).over(Window.partitionBy(*leaf.grain)))
        seen = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"_seen_{t}"), F.lit(0)) for t in complete))
        return out.filter(seen > 0) if self.by else out


@dataclass(frozen=True)
class Model:
    """Tables by name; columns that mean the same have the same name."""

    tables: dict[str, DataFrame]


def with_month(df: DataFrame, date: str = "TRANSACTION_DATE") -> DataFrame:
    """Adds ``month``; of a month-partitioned table from the partition column, so that conditions on it prune folders."""
    if "TXN_MONTH" in df.columns:
        return df.withColumn(MONTH, F.to_date(F.concat(F.col("TXN_MONTH"), F.lit("-01"))))
    return df.withColumn(MONTH, kpi.month_date(date))


def model_of(star: Star) -> Model:
    """The star with the report's column names on every table."""
    targets = star.kpi_targets.withColumnRenamed("SUBSIDIARY_NAME", "SUBSIDIARY").withColumn(MONTH, F.to_date("TARGET_MONTH"))
    return Model({
        FACT: with_month(star.transactions), "kpi_targets": targets, "agents": star.agents, "customers": star.customers,
    })


def conditions(filters: dict | None) -> list[Condition]:
    return [as_condition(c, v) for c, v in (filters or {}).items()]


def evaluate(model: Model, measures: dict[str, Measure], by: list[str], filters: dict | None = None, drop_blank: bool = False) -> DataFrame:
    """One row per cell of ``by`` with the measures; ``filters``: column -> member, members or Condition.

    With ``drop_blank`` cells in which every measure is blank have no row.
    """
    plan = _Plan(model, list(by), frozenset(conditions(filters)))
    for m in measures.values():
        plan.collect(m)
    out = plan.joined().select(*by, *[plan.value(m).alias(name) for name, m in measures.items()])
    return out.dropna("all", subset=list(measures)) if drop_blank else out


def sliced(star: Star, filters: dict | None) -> Star:
    """The star under slicers: each table keeps the rows that fit the conditions on columns it has.

    ``month`` and ``SUBSIDIARY`` mean the same on transactions, targets and rates (a customer's home subsidiary is another
    thing). Any report of the star then runs in that context.
    """
    given = conditions(filters)
    if not given:
        return star
    names = {"kpi_targets": {"SUBSIDIARY": "SUBSIDIARY_NAME"}, "forex_rates": {"SUBSIDIARY": "SUBSIDIARY_NAME"}}
    months = {"transactions": None, "kpi_targets": "TARGET_MONTH", "forex_rates": "RATE_MONTH"}
    out = {}
    for table in ("transactions", "agents", "customers", "kpi_targets", "forex_rates"):
        df = original = getattr(star, table)
        kept = df.columns
        if table in months and any(MONTH in c.columns for c in given) and MONTH not in kept:
            df = with_month(df) if table == "transactions" else df.withColumn(MONTH, F.trunc(F.to_date(months[table]), "month"))
        for new, old in names.get(table, {}).items():
            df = df.withColumn(new, F.col(old))
        have = set(df.columns)
        met = _met([c for c in given if have >= {*c.columns}])
        out[table] = original if met is None else df.filter(met).select(*kept)
    return replace(star, **out, folder=None)
