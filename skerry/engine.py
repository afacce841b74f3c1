"""The engine as a user meets it: Engine -> Connection -> results and prepared statements."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from skerry.errors import EngineError
from skerry.functions import exprs
from skerry.functions.udf import Functions
from skerry.operators import changes, schema
from skerry.plans import tree as t
from skerry.plans.lower import Lowering, Relation, Result, relation
from skerry.plans.parser import parse
from skerry.sources.store import RID, TableStore


class ResultSet:
    """Rows of a query. Iterating fetches a partition at a time."""

    def __init__(self, result: Result):
        self.frame, self.columns = result.df, list(zip(result.names, result.kinds, strict=True))

    def __iter__(self) -> Iterator[tuple]:
        return (tuple(row) for row in self.frame.toLocalIterator())

    def rows(self) -> list[tuple]:
        return [tuple(row) for row in self.frame.collect()]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]


class Engine:
    """Stored tables under a root folder (or none), DataFrames registered as relations, and user functions.

    Names are told apart by case in this dialect, so the session's spark.sql.caseSensitive is set.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.spark, self.store = spark, TableStore(spark, root) if root else None
        self.functions = Functions()
        self._frames: dict[str, tuple[DataFrame | Callable[[], DataFrame], tuple[str, ...]]] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], key: Sequence[str] = ()) -> None:
        """Makes a DataFrame a relation that queries can read; key orders its rows where ORDER BY leaves ties.

        A function that gives the DataFrame is called when a query first names it, so files that no query reads are never opened.
        """
        self._frames[name] = (df, tuple(key))

    def register_udf(self, name: str, function: Callable, signature: str, vector: bool = True) -> None:
        self.functions.register(name, function, signature, vector)

    def register_udaf(self, name: str, function: Callable, signature: str) -> None:
        self.functions.register_aggregate(name, function, signature)

    def connect(self) -> Connection:
        return Connection(self)

    def relation(self, name: str, alias: str | None) -> Relation:
        if self.store and self.store.exists(name):
            meta = self.store.meta(name)
            out = relation(self.store.read(meta), alias or name, meta.names, [c.kind for c in meta.columns], [*meta.primary, RID])
            out.tables = [(alias or name, name, out.keys[-1])]
            return out
        if name in self._frames:
            df, key = self._frames[name]
            if not isinstance(df, DataFrame):
                df = df()
                self._frames[name] = (df, key)
            return relation(df, alias or name, df.columns, None, key)
        raise EngineError(f"Table: {name} not found")


class Connection:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _lowering(self, parameters: Sequence[Any] = ()) -> Lowering:
        return Lowering(self.engine.spark, self.engine.relation, self.engine.functions, parameters)

    def _run(self, statement: t.Statement, parameters: Sequence[Any] = ()) -> int | ResultSet:
        if statement.parameters > len(parameters):
            raise EngineError("Not all value bound in PreparedStatement.")
        node, lowering, store = statement.tree, self._lowering(parameters), self.engine.store
        if isinstance(node, (t.Select, t.Union, t.With)):
            return ResultSet(lowering.query(node))
        if store is None:
            raise EngineError("There are no stored tables")
        match node:
            case t.CreateTable():
                return schema.create_table(store, node)
            case t.DropTable():
                return schema.drop_table(store, node)
            case t.CreateIndex():
                return schema.create_index(store, node)
            case t.DropIndex():
                return schema.drop_index(store, node)
            case t.Alter():
                return schema.alter(store, lowering, node)
            case t.Insert():
                return changes.insert(store, lowering, node)
            case t.Delete():
                return changes.delete(store, lowering, node)
            case t.Update():
                return changes.update(store, lowering, node)
        raise EngineError(f"Not a statement: {node}")

    def execute(self, script: str) -> int:
        """Runs the statements of a script; the last one's count of affected rows (0 for a query)."""
        affected = 0
        for statement in parse(script):
            out = self._run(statement)
            affected = 0 if isinstance(out, ResultSet) else out
        return affected

    def execute_file(self, path: str) -> int:
        """Runs a script file, read by Spark from any of its file systems."""
        rows = self.engine.spark.read.text(path, wholetext=True).collect()
        return self.execute("\n".join(r[0] for r in rows))

    def query(self, sql: str) -> ResultSet:
        (statement,) = parse(sql)
        out = self._run(statement)
        if not isinstance(out, ResultSet):
            raise EngineError("Not select statement")
        return out

    def prepare(self, sql: str) -> PreparedStatement:
        (statement,) = parse(sql)
        return PreparedStatement(self, statement)

    def explain(self, sql: str) -> str:
        """The physical plan of a query."""
        return self.query(sql).frame._jdf.queryExecution().toString()


class PreparedStatement:
    """A statement with `?` in it; values are bound by place, from 0."""

    _MISSING = object()

    def __init__(self, connection: Connection, statement: t.Statement):
        self.connection, self.statement = connection, statement
        self._values: list[Any] = [self._MISSING] * statement.parameters

    def bind(self, place: int, value: int | float | str | None) -> PreparedStatement:
        self._values[place] = value
        return self

    def _bound(self) -> list[Any]:
        if any(v is self._MISSING for v in self._values):
            raise EngineError("Not all value bound in PreparedStatement.")
        return self._values

    def execute(self) -> int:
        out = self.connection._run(self.statement, self._bound())
        return 0 if isinstance(out, ResultSet) else out

    def query(self) -> ResultSet:
        out = self.connection._run(self.statement, self._bound())
        if not isinstance(out, ResultSet):
            raise EngineError("Not select statement")
        return out


def header(engine: Engine, table: str) -> str:
    """A stored table's columns as `|-name:TYPE-|…`."""
    return "".join(f"|-{c.name}:{c.shown_type}-" for c in engine.store.meta(table).columns) + "|"


__all__ = ["Connection", "Engine", "PreparedStatement", "ResultSet", "exprs", "header"]
