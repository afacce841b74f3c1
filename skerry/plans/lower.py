"""Queries as DataFrames. Names are resolved here; everything else is left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.functions import exprs
from skerry.functions.udf import Functions
from skerry.operators import relational as r
from skerry.plans import tree as t

AGGREGATES = {"count", "sum", "avg", "min", "max"}
#: Functions of Spark that come along under their own names: name -> (function, kind of the result, None for that of the first argument).
EXTRAS: dict[str, tuple[Callable, str | None]] = {
    "abs": (F.abs, None), "ceil": (F.ceil, "int"), "floor": (F.floor, "int"), "round": (F.round, None), "sqrt": (F.sqrt, "float"), "upper": (F.upper, "str"), "lower": (F.lower, "str"),
    "trim": (F.trim, "str"), "char_length": (F.char_length, "int"), "coalesce": (F.coalesce, None), "nullif": (F.nullif, None), "replace": (F.replace, "str"), "reverse": (F.reverse, "str"),
}
_fresh = count()


@dataclass(frozen=True)
class Field:
    table: str | None
    name: str
    column: str
    kind: str


@dataclass
class Relation:
    """A DataFrame whose columns have unique inner names, what they are called outside, and the inner names that tell rows apart in order."""

    df: DataFrame
    fields: list[Field]
    keys: list[str] = field(default_factory=list)
    tables: list[tuple[str, str, str]] = field(default_factory=list)  # (alias, table, inner name of its row number)


@dataclass
class Result:
    """A query's rows; columns may share names, so they are told apart by position."""

    df: DataFrame
    names: list[str]
    kinds: list[str]


def relation(df: DataFrame, alias: str | None, names: Sequence[str], kinds: Sequence[str] | None = None, keys: Sequence[str] = ()) -> Relation:
    """Gives every column of df an inner name; keys are columns of df that order its rows, hidden from queries if not in names."""
    hidden = [k for k in keys if k not in names]
    given = [*names, *hidden]
    inner = [f"_{next(_fresh)}" for _ in given]
    out = df.toDF(*inner)
    kinds = kinds or [exprs.kind_of(f.dataType) for f in df.schema.fields[: len(names)]]
    return Relation(out, [Field(alias, n, c, k) for n, c, k in zip(names, inner, kinds, strict=False)], [inner[given.index(k)] for k in keys])


class Lowering:
    def __init__(self, spark: SparkSession, tables: Callable[[str, str | None], Relation], functions: Functions | None = None, parameters: Sequence[Any] = ()):
        self.spark, self.tables, self.functions, self.parameters = spark, tables, functions or Functions(), parameters
        self.named: dict[str, Result] = {}

    # ---- relations

    def source(self, node) -> Relation:
        if isinstance(node, t.Table):
            if node.name in self.named:
                q = self.named[node.name]
                return relation(q.df, node.alias or node.name, q.names, q.kinds)
            return self.tables(node.name, node.alias)
        if isinstance(node, t.Derived):
            q = self.query(node.query)
            return relation(q.df, node.alias, q.names, q.kinds)
        left, right = self.source(node.left), self.source(node.right)
        both = Relation(left.df, left.fields + right.fields, left.keys + right.keys, left.tables + right.tables)
        both.df = r.joined(left.df, right.df, self.condition(node.on, both), node.how)
        return both

    # ---- queries

    def query(self, node) -> Result:
        if isinstance(node, t.With):
            outer = dict(self.named)
            for name, columns, inner in node.parts:
                q = self.query(inner)
                if columns and len(columns) != len(q.names):
                    raise EngineError(f"Different number of columns, left is {len(columns)}, but right is {len(q.names)}")
                self.named[name] = Result(q.df, list(columns or q.names), q.kinds)
            out = self.query(node.query)
            self.named = outer
            return out
        if isinstance(node, t.Union):
            left, right = self.query(node.left), self.query(node.right)
            return Result(r.united(left.df, right.df, node.all), left.names, [a if a != "null" else b for a, b in zip(left.kinds, right.kinds, strict=True)])
        return self.select(node)

    def select(self, node: t.Select) -> Result:
        if node.source is None:
            if any(isinstance(i.expr, t.Star) for i in node.items):
                raise EngineError("No columns for star(*)")
            made = [self.expr(i.expr, Relation(r.one_row(self.spark), [])) for i in node.items]
            names = [i.alias or f"_{k}" for k, i in enumerate(node.items)]
            return self._result(r.one_row(self.spark), made, names)
        rel = self.source(node.source)
        if node.where is not None:
            rel.df = rel.df.filter(self.where(node.where, rel))
        items = self._expanded(node.items, rel)
        known: dict[Any, tuple[Column, str]] = {}
        aliases = {i.alias: i.expr for i in items if i.alias}
        order = [(aliases[e.name] if isinstance(e, t.Name) and e.table is None and e.name in aliases and not any(f.name == e.name for f in rel.fields) else e, down) for e, down in node.order]
        calls = list(dict.fromkeys(c for e in (*(i.expr for i in items), node.having, *(e for e, _ in order)) for c in self.aggregates(e)))
        if node.group or calls:
            if not calls:
                raise EngineError("Group by clause without aggregator")
            rel, known = self._grouped(node, items, order, calls, rel)
        names, unnamed = [], 0
        for i in items:
            if i.alias:
                names.append(i.alias)
            elif isinstance(i.expr, t.Name):
                names.append(i.expr.name)
            else:
                unnamed += 1
                names.append(f"_{unnamed}")
        made = [self.expr(i.expr, rel, known) for i in items]
        limit, offset = self._number(node.limit), self._number(node.offset) or 0
        if node.distinct:
            out = self._result(rel.df, made, names)
            out.df = out.df.distinct()
            if order:
                places = {i.expr: k for k, i in enumerate(items)}
                if any(e not in places for e, _ in order):
                    raise EngineError("ORDER BY of SELECT DISTINCT must be in the select list")
                inner = out.df.toDF(*(f"_{next(_fresh)}" for _ in names))
                inner = r.ordered(inner, [(F.col(inner.columns[places[e]]), down) for e, down in order])
                out.df = r.limited(inner, limit, offset).toDF(*names)
                return out
            out.df = r.limited(out.df, limit, offset)
            return out
        if order:
            rel.df = r.ordered(rel.df, [(exprs.shown(*self.expr(e, rel, known)), down) for e, down in order], rel.keys)
        rel.df = r.limited(rel.df, limit, offset)
        return self._result(rel.df, made, names)

    def _result(self, df: DataFrame, made: list[tuple[Column, str]], names: list[str]) -> Result:
        return Result(df.select(*(exprs.shown(c, k).alias(n) for (c, k), n in zip(made, names, strict=True))), names, ["int" if k == "bool" else k for _, k in made])

    def _expanded(self, items: Sequence[t.Item], rel: Relation) -> list[t.Item]:
        out = []
        for i in items:
            if not isinstance(i.expr, t.Star):
                out.append(i)
                continue
            found = [f for f in rel.fields if i.expr.table in (None, f.table)]
            if not found:
                raise EngineError("No columns for star(*)")
            out += [t.Item(t.Name(f.name, f.table), f.name) for f in found]
        return out

    def _grouped(self, node: t.Select, items, order, calls, rel: Relation) -> tuple[Relation, dict]:
        known: dict[Any, tuple[Column, str]] = {}
        keys, aggregates = [], []
        for e in node.group:
            if self.aggregates(e):
                raise EngineError("Aggregate function in GROUP BY")
            c, kind = self.expr(e, rel)
            name = f"_{next(_fresh)}"
            keys.append(exprs.shown(c, kind).alias(name))
            known[e] = (F.col(name), "int" if kind == "bool" else kind)
        for call in calls:
            c, kind = self._aggregate(call, rel)
            name = f"_{next(_fresh)}"
            aggregates.append(c.alias(name))
            known[call] = (F.col(name), kind)
        # a column that is neither a key nor aggregated has the value of the group's last row
        loose = [n for e in (*(i.expr for i in items), node.having, *(e for e, _ in order)) for n in names_outside(e, known)]
        rows = [F.col(k) for k in rel.keys] or [F.col(f.column) for f in rel.fields if f.kind != "other"]
        for n in dict.fromkeys(loose):
            c, kind = self.expr(n, rel)
            name = f"_{next(_fresh)}"
            aggregates.append(exprs.last_row(c, rows).alias(name))
            known[n] = (F.col(name), kind)
        out = Relation(r.grouped(rel.df, keys, aggregates), rel.fields)
        if node.having is not None:
            c, kind = self.expr(node.having, out, known)
            out.df = out.df.filter(exprs.truthy(c, kind))
        return out, known

    def aggregates(self, node) -> list[t.Call]:
        """The aggregate calls of an expression, the engine's and users' own."""
        if isinstance(node, t.Call) and (node.name in AGGREGATES or self.functions.find_aggregate(node.name)):
            return [node]
        return [c for x in children(node) for c in self.aggregates(x)]

    def _aggregate(self, call: t.Call, rel: Relation) -> tuple[Column, str]:
        if any(self.aggregates(a) for a in call.args):
            raise EngineError("Nested aggregate function")
        if call.name not in AGGREGATES:
            function, arity, result = self.functions.find_aggregate(call.name)
            if arity != len(call.args) or call.distinct or any(isinstance(a, t.Star) for a in call.args):
                raise EngineError(f"Invalid number of arguments, need {arity}, expected: {len(call.args)}")
            return function(*(exprs.shown(*self.expr(a, rel)) for a in call.args)).cast(result), exprs.kind_of(result)
        if call.name == "count":
            if not call.args or isinstance(call.args[0], (t.Star, t.Literal)) and getattr(call.args[0], "value", 0) is not None:
                return F.count(F.lit(1)), "int"
            made = [exprs.shown(*self.expr(a, rel)) for a in call.args]
            return (F.count_distinct(*made) if call.distinct else F.count(made[0])), "int"
        if len(call.args) != 1 or isinstance(call.args[0], t.Star):
            raise EngineError(f"Invalid number of arguments, need 1, expected: {len(call.args)}")
        c, kind = self.expr(call.args[0], rel)
        if call.name in ("min", "max"):
            return (F.min if call.name == "min" else F.max)(exprs.shown(c, kind)), "int" if kind == "bool" else kind
        number = exprs.to_number(c, kind)
        if call.name == "avg":
            return F.avg(F.when(F.lit(True), number)) if not call.distinct else F.avg(number), "float"
        return (F.sum_distinct(number) if call.distinct else F.sum(number)), exprs.number_kind(kind)

    def _number(self, node) -> int | None:
        if node is None:
            return None
        value = self.constant(node)
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise EngineError("Require integral literal by limit of offset clause")
        return value

    def constant(self, node) -> Any:
        """The value of an expression without columns; only one that isn't a literal asks Spark."""
        if isinstance(node, t.Parameter):
            return self._parameter(node)
        if isinstance(node, t.Literal):
            return node.value
        c, kind = self.expr(node, Relation(None, []))
        return self.spark.range(1).select(exprs.shown(c, kind)).first()[0]

    def _parameter(self, node: t.Parameter) -> Any:
        if node.index >= len(self.parameters):
            raise EngineError("Not all value bound in PreparedStatement.")
        return self.parameters[node.index]

    # ---- expressions

    def condition(self, node, rel: Relation) -> Column:
        return exprs.truthy(*self.expr(node, rel))

    def where(self, node, rel: Relation) -> Column:
        """The condition of a WHERE, where unknown counts as false, so NOT IN (SELECT …) becomes a plain anti join that can shuffle.

        Spark's own plan for it broadcasts every key of the subquery. Whether there are keys and NULLs among them are two counts.
        """
        if isinstance(node, t.Binary) and node.op == "and":
            return self.where(node.left, rel) & self.where(node.right, rel)
        if not (isinstance(node, t.In) and node.negated and node.query is not None):
            return self.condition(node, rel)
        c, kind = self.expr(node.of, rel)
        inner, key = self._single(node.query), f"_{next(_fresh)}"
        df, c = inner.df.toDF(key), exprs.shown(c, kind)
        sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known"))
        met = df.filter(F.col(key) == c.outer()).exists()
        return ~met & ((sizes.select("n").scalar() == 0) | c.isNotNull() & (sizes.select(F.col("n") == F.col("known")).scalar()))

    def _single(self, query) -> Result:
        inner = self.query(query)
        if len(inner.names) != 1:
            raise EngineError(f"Different number of columns, left is 1, but right is {len(inner.names)}")
        return inner

    def expr(self, node, rel: Relation, known: dict | None = None) -> tuple[Column, str]:
        if known and node in known:
            return known[node]
        go = lambda n: self.expr(n, rel, known)
        match node:
            case t.Parameter():
                return self._literal(self._parameter(node))
            case t.Literal():
                return self._literal(node.value)
            case t.Name():
                found = [f for f in rel.fields if f.name == node.name and node.table in (None, f.table)]
                if not found:
                    raise EngineError(f"Unresolved symbol: {node.table + '.' if node.table else ''}{node.name}")
                return F.col(found[0].column), found[0].kind
            case t.Unary(op="-"):
                c, kind = go(node.of)
                return -exprs.to_number(c, kind), exprs.number_kind(kind)
            case t.Unary():
                return ~exprs.truthy(*go(node.of)), "bool"
            case t.Binary():
                return self._binary(node, go)
            case t.IsNull():
                c, _ = go(node.of)
                return (c.isNotNull() if node.negated else c.isNull()), "bool"
            case t.In():
                c, kind = go(node.of)
                if node.query is not None:
                    out = exprs.shown(c, kind).isin(self._single(node.query).df)
                elif len(node.items) > 1 and all(isinstance(x, t.Literal) and type(x.value) is {"int": int, "str": str}.get(kind) for x in node.items):
                    out = c.isin([x.value for x in node.items])
                else:
                    out = None
                    for x in node.items:
                        one = self._compare("=", node.of, c, kind, x, *go(x))
                        out = one if out is None else out | one
                return (~out if node.negated else out), "bool"
            case t.Between():
                c, kind = go(node.of)
                out = self._compare(">=", node.of, c, kind, node.low, *go(node.low)) & self._compare("<=", node.of, c, kind, node.high, *go(node.high))
                return (~out if node.negated else out), "bool"
            case t.Like():
                out = exprs.text(*go(node.of)) if go(node.of)[1] != "str" else go(node.of)[0]
                out = F.like(out, go(node.pattern)[0])
                return (~out if node.negated else out), "bool"
            case t.Case():
                return self._case(node, go)
            case t.Call():
                return self._call(node, go)
        raise EngineError(f"Not an expression: {node}")

    def _literal(self, value: Any) -> tuple[Column, str]:
        if value is None:
            return F.lit(None).cast("string"), "null"
        if isinstance(value, bool):
            return F.lit(int(value)), "int"
        return F.lit(value), "int" if isinstance(value, int) else "float" if isinstance(value, float) else "str"

    def _compare(self, op: str, na, a: Column, ka: str, nb, b: Column, kb: str) -> Column:
        # a text literal against a number is turned into a number here, so the comparison still reaches the scan
        for node, kind in ((na, kb), (nb, ka)):
            value = self._parameter(node) if isinstance(node, t.Parameter) else getattr(node, "value", None)
            if isinstance(value, str) and kind in ("int", "float"):
                column, k = self._literal(number_of(value))
                if node is na:
                    a, ka = column, k
                else:
                    b, kb = column, k
        if ka == "null" and kb in ("int", "float"):
            a = a.cast("double")
        if kb == "null" and ka in ("int", "float"):
            b = b.cast("double")
        return exprs.compare(op, a, ka, b, kb)

    def _binary(self, node: t.Binary, go) -> tuple[Column, str]:
        (a, ka), (b, kb) = go(node.left), go(node.right)
        if node.op in ("and", "or"):
            x, y = exprs.truthy(a, ka), exprs.truthy(b, kb)
            return (x & y if node.op == "and" else x | y), "bool"
        if node.op == "/":
            return exprs.divide(a, ka, b, kb)
        if node.op in ("+", "-", "*", "%"):
            whole = exprs.number_kind(ka) == exprs.number_kind(kb) == "int"
            x, y = (c if whole else c.cast("double") for c in (exprs.to_number(a, ka), exprs.to_number(b, kb)))
            if node.op == "%":
                y = F.nullif(y, F.lit(0).cast("bigint" if whole else "double"))
            return {"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "%": x.__mod__}[node.op](y), "int" if whole else "float"
        return self._compare(node.op, node.left, a, ka, node.right, b, kb), "bool"

    def _case(self, node: t.Case, go) -> tuple[Column, str]:
        values = [go(v) for _, v in node.whens] + ([go(node.otherwise)] if node.otherwise is not None else [])
        kinds = {"int" if k == "bool" else k for _, k in values} - {"null"}
        kind = kinds.pop() if len(kinds) == 1 else "null" if not kinds else "float" if kinds == {"int", "float"} else "str"
        cast = {"int": "bigint", "float": "double", "str": "string"}
        fit = lambda c, k: exprs.text(c, k) if kind == "str" and k not in ("str", "null") else exprs.shown(c, k).cast(cast[kind]) if kind in cast else c
        out = None
        for (test, _), (c, k) in zip(node.whens, values, strict=False):
            when = exprs.truthy(*go(test)) if node.of is None else self._compare("=", node.of, *go(node.of), test, *go(test))
            out = F.when(when, fit(c, k)) if out is None else out.when(when, fit(c, k))
        if node.otherwise is not None:
            out = out.otherwise(fit(*values[-1]))
        return out, kind

    def _call(self, node: t.Call, go) -> tuple[Column, str]:
        if node.name in AGGREGATES or self.functions.find_aggregate(node.name):
            raise EngineError(f"Aggregate function {node.name} is not allowed here")
        args = [go(a) for a in node.args if not isinstance(a, t.Star)]
        if node.name == "version":
            return F.lit(exprs.VERSION), "str"
        if node.name == "length":
            return exprs.length(*args[0]) if args else exprs.length(None), "int"
        if node.name == "concat":
            return exprs.concat(*args), "str"
        if found := self.functions.find(node.name):
            function, arity, result = found
            if arity != len(args):
                raise EngineError(f"Invalid number of arguments, need {arity}, expected: {len(args)}")
            return function(*(c for c, _ in args)), exprs.kind_of(result)
        if node.name in EXTRAS and args:
            function, kind = EXTRAS[node.name]
            return function(*(c for c, _ in args)), kind or args[0][1]
        raise EngineError(f"UDF: {node.name} not found in this env.")


def number_of(value: str) -> int | float | None:
    for kind in (int, float):
        try:
            return kind(value) if value == value.strip() and "_" not in value else None
        except ValueError:
            pass
    return None


def children(node) -> list:
    """The expressions right below a node; subqueries are closed."""
    if not hasattr(node, "__dataclass_fields__") or isinstance(node, (t.Select, t.Union, t.With)):
        return []
    out = []
    for name in node.__dataclass_fields__:
        value = getattr(node, name)
        for x in value if isinstance(value, tuple) else (value,):
            out += list(x) if isinstance(x, tuple) else [x]
    return [x for x in out if hasattr(x, "__dataclass_fields__")]


def names_outside(node, known: dict) -> list[t.Name]:
    """Column names of an expression that are not within something known."""
    if node is None or node in known:
        return []
    return [node] if isinstance(node, t.Name) else [n for x in children(node) for n in names_outside(x, known)]
