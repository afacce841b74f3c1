"""INSERT, UPDATE and DELETE on stored tables: each plans its rows, checks the outcome of every table, and then commits.

A table changes whole or not at all. Where a statement changes several tables, they are committed one after the other when all have been written and checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.functions import exprs
from skerry.operators import relational as r
from skerry.plans import tree as t
from skerry.plans.lower import Lowering, Relation, number_of
from skerry.plans.parser import parse_expression
from skerry.sources.store import RID, STORED, ColumnMeta, TableMeta, TableStore


def fitted(value: Any, c: ColumnMeta) -> Any:
    """A value as the column keeps it: whole to float, float to whole by cutting, numbers to text, text to a number or else NULL (0 if NOT NULL)."""
    if value is None:
        return None
    if c.kind == "str":
        if isinstance(value, float):
            return repr(value).removesuffix(".0")
        return str(int(value)) if isinstance(value, (int, bool)) else value
    if isinstance(value, str):
        value = number_of(value)
        if value is None:
            return (0 if c.kind == "int" else 0.0) if c.not_null else None
    return int(value) if c.kind == "int" else float(value)


def fitted_column(value: Column, kind: str, c: ColumnMeta) -> Column:
    """The same for a column expression."""
    if c.kind == "str":
        return value if kind in ("str", "null") else F.when(value.isNotNull(), exprs.text(value, kind))
    number = exprs.to_number(value, "str" if kind == "null" else kind)
    if c.not_null and kind == "str":
        number = F.when(value.isNotNull(), F.coalesce(number, F.lit(0).cast("double")))
    if c.kind == "int" and kind in ("float", "str", "null"):
        number = F.when(number.isNotNull(), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    return number.cast(STORED[c.type])


def check_unique(meta: TableMeta, rows: DataFrame, primary: str, unique: str) -> None:
    """Fails if rows repeat a primary key or a unique index's key; keys with NULL are not held against each other in an index."""
    repeated = lambda names, df: not df.groupBy(*names).count().filter("count > 1").isEmpty()
    if meta.primary and repeated(meta.primary, rows):
        raise EngineError(primary)
    for i in meta.indexes:
        if i.unique and repeated(i.columns, rows.dropna(subset=i.columns)):
            raise EngineError(unique.format(i.name))


def default_of(c: ColumnMeta, lowering: Lowering) -> Any:
    return None if c.default is None else lowering.constant(parse_expression(c.default))


def insert(store: TableStore, lowering: Lowering, node: t.Insert) -> int:
    """VALUES rows: the row count is the statement's own, so they are made on the driver."""
    meta = store.meta(node.table)
    given = [meta.column(n) for n in node.columns]
    defaults: dict[str, Any] = {}
    tuples = []
    for values in node.rows:
        if len(values) != len(given):
            raise EngineError(f"Different number of values, columns are {len(given)}, but values are {len(values)}")
        row = {c.name: lowering.constant(v) for c, v in zip(given, values, strict=True)}
        meta.counter += any(c.auto for c in meta.columns)
        for c in meta.columns:
            if row.get(c.name) is None and c.auto:
                row[c.name] = meta.counter
            elif c.name not in row:
                if c.name not in defaults:
                    defaults[c.name] = default_of(c, lowering)
                row[c.name] = defaults[c.name]
            row[c.name] = fitted(row[c.name], c)
            if row[c.name] is None and c.not_null:
                raise EngineError(f"Column: {c.name} must not be null in table: {meta.name}")
            if c.name in meta.primary and c.size is not None and len(row[c.name].encode()) > c.size:
                raise EngineError("Char type too long" if c.type == "char" else "Varchar type too long")
        tuples.append((*(row[c.name] for c in meta.columns), meta.next_rid))
        meta.next_rid += 1
    schema = ", ".join([*(f"`{c.name}` {STORED[c.type].simpleString()}" for c in meta.columns), f"{RID} bigint"])
    rows = store.spark.createDataFrame(tuples, schema)
    _check_insert(store, meta, rows)
    store.append(meta, rows)
    return len(tuples)


def insert_frame(store: TableStore, table: str, df: DataFrame) -> int:
    """A DataFrame's rows as new rows of a table without auto-increment; columns go by name, those left out are NULL or the default."""
    meta = store.meta(table)
    lowering = Lowering(store.spark, lambda *_: None)
    missing = {c.name: default_of(c, lowering) for c in meta.columns if c.name not in df.columns}
    if any(c.auto and c.name in missing for c in meta.columns):
        raise EngineError(f"Auto increment columns of table: {table} must be given")
    made = [fitted_column(F.lit(missing[c.name]).cast(STORED[c.type]) if c.name in missing else F.col(c.name), c.kind if c.name in missing else exprs.kind_of(df.schema[c.name].dataType), c).alias(c.name) for c in meta.columns]
    rows = df.select(*made, (F.monotonically_increasing_id() + F.lit(meta.next_rid)).alias(RID))
    for c in meta.columns:
        if c.not_null and not rows.filter(F.col(c.name).isNull()).isEmpty():
            raise EngineError(f"Column: {c.name} must not be null in table: {meta.name}")
    _check_insert(store, meta, rows)
    folder = store.write(meta, rows)
    added = store.spark.read.parquet(f"{store.root}/{folder}").agg(F.count("*").alias("n"), F.max(RID).alias("top")).first()
    meta.folders, meta.next_rid = store.compacted(meta, [*meta.folders, folder]), (added["top"] + 1 if added["n"] else meta.next_rid)
    store.commit(meta)
    return added["n"]


def _check_insert(store: TableStore, meta: TableMeta, rows: DataFrame) -> None:
    keys = [("Duplicated primary key, must be unique.", meta.primary)] if meta.primary else []
    keys += [(f"Duplicated secondary key, index {i.name} is unique.", i.columns) for i in meta.indexes if i.unique]
    current = store.read(meta) if keys else None
    for message, names in keys:
        new = rows.select(*names).dropna()
        if not new.groupBy(*names).count().filter("count > 1").isEmpty() or meta.folders and not new.join(current.select(*names), list(names), "left_semi").isEmpty():
            raise EngineError(message)


def _chosen(lowering: Lowering, source, where, order: Sequence, limit) -> Relation:
    """The rows that a change is for."""
    rel = lowering.source(source)
    if where is not None:
        rel.df = rel.df.filter(lowering.where(where, rel))
    if order or limit is not None:
        rel.df = r.ordered(rel.df, [(exprs.shown(*lowering.expr(e, rel)), down) for e, down in order], rel.keys)
        rel.df = r.limited(rel.df, lowering._number(limit))
    return rel


def _target(rel: Relation, name: str) -> tuple[str, str, str]:
    for entry in rel.tables:
        if name in entry[:2]:
            return entry
    raise EngineError(f"Table: {name} not found")


def delete(store: TableStore, lowering: Lowering, node: t.Delete) -> int:
    """Takes the chosen rows out of every target table, which several aliases may name; the count is that of rows deleted."""
    rel = _chosen(lowering, node.source, node.where, node.order, node.limit)
    rel.df = rel.df.select(*(rid for _, _, rid in rel.tables)).cache()
    by_table: dict[str, list[str]] = {}
    for name in node.targets:
        _, table, rid = _target(rel, name)
        by_table.setdefault(table, []).append(rid)
    plans, total = [], 0
    try:
        for table, rids in by_table.items():
            gone = reduce(DataFrame.unionAll, (rel.df.select(F.col(rid).alias(RID)) for rid in rids)).dropna().distinct()
            meta, n = store.meta(table), gone.count()
            total += n
            if n:
                hit, others = store.holding(meta, gone)
                plans.append((meta, [*others, store.write(meta, store.read(meta, hit).join(gone, RID, "left_anti"))]))
        for meta, folders in plans:
            meta.folders = store.compacted(meta, folders)
            store.commit(meta)
    finally:
        rel.df.unpersist()
    return total


def update(store: TableStore, lowering: Lowering, node: t.Update) -> int:
    """Assigns from left to right, later ones seeing earlier results. Where several joined rows meet one row, the last by the tables' keys counts;
    where several aliases of one table do, the last of those that set the column.

    The count is that of chosen rows times the tables of the join.
    """
    rel = _chosen(lowering, node.source, node.where, node.order, node.limit)
    targets: dict[str, dict[str, Column]] = {}
    several = len(rel.tables) > 1
    made: dict = {}
    for name, value in node.sets:
        if name.table is None and several:
            raise EngineError(f"Obscure assignment name: {name.name}")
        alias, table, rid = _target(rel, name.table) if name.table else rel.tables[0]
        c = store.meta(table).column(name.name)
        column = fitted_column(*lowering.expr(value, rel, made), c)
        targets.setdefault(alias, {})[name.name] = column
        made[t.Name(name.name, alias)] = (column, c.kind)
        if sum(x == table for _, x, _ in rel.tables) == 1:
            made[t.Name(name.name, table)] = (column, c.kind)
        if not several:
            made[t.Name(name.name)] = (column, c.kind)
    outputs = [c.alias(f"{alias}.{n}") for alias, sets in targets.items() for n, c in sets.items()]
    keys = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(rel.keys)))
    chosen = rel.df.select(*(F.col(rid).alias(f"{alias}.{RID}") for alias, _, rid in rel.tables), keys.alias("_order"), *outputs).cache()
    by_table: dict[str, list[str]] = {}
    for alias in targets:
        by_table.setdefault(_target(rel, alias)[1], []).append(alias)
    plans = []
    try:
        affected = chosen.count() * len(rel.tables)
        for table, aliases in by_table.items():
            meta = store.meta(table)
            names = list(dict.fromkeys(n for a in aliases for n in targets[a]))
            # for each alias that sets a column its value in a struct, so that a NULL that is set differs from nothing set
            one = lambda k, a: chosen.filter(F.col(f"`{a}.{RID}`").isNotNull()).select(F.col(f"`{a}.{RID}`").alias(RID), F.struct(F.lit(k).alias("alias"), "_order").alias("_order"), *((F.struct(F.col(f"`{a}.{n}`").alias("v")) if n in targets[a] else F.lit(None).cast(f"struct<v:{STORED[meta.column(n).type].simpleString()}>")).alias(n) for n in names))
            every = reduce(DataFrame.unionAll, (one(k, a) for k, a in enumerate(aliases)))
            news = every.groupBy(RID).agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_order"))).alias(f"_new_{n}") for n in names))
            hit, others = store.holding(meta, news.select(RID)) if meta.folders else ([], [])
            if not hit:
                continue
            current = store.read(meta, hit).join(news, RID, "left")
            image = current.select(*(F.when(F.col(f"_new_{c.name}").isNotNull(), F.col(f"_new_{c.name}.v")).otherwise(F.col(c.name)).alias(c.name) if c.name in names else F.col(c.name) for c in meta.columns), RID)
            folder = store.write(meta, image)
            _check_update(store, meta, names, news.select(RID), hit, folder, others)
            plans.append((meta, [*others, folder]))
        for meta, folders in plans:
            meta.folders = store.compacted(meta, folders)
            store.commit(meta)
    finally:
        chosen.unpersist()
    return affected


def _check_update(store: TableStore, meta: TableMeta, names: Sequence[str], rids: DataFrame, hit: list[str], folder: str, others: list[str]) -> None:
    """NOT NULL of columns that were set, and of keys that hold one of them that no changed row repeats another's; other rows are not held against each other."""
    fresh = store.read(meta, [folder]).join(rids, RID, "left_semi")
    for n in names:
        if meta.column(n).not_null and not fresh.filter(F.col(n).isNull()).isEmpty():
            raise EngineError(f"Column: {n} must not be null in table: {meta.name}")
    keys = [(meta.primary, f"Duplicated primary key, in table: {meta.name}")] + [(i.columns, f"Duplicated unique secondary index key: {i.name}, in table: {meta.name}") for i in meta.indexes if i.unique]
    for columns, message in keys:
        if not set(columns) & set(names):
            continue
        mine = fresh.select(*columns).dropna()
        kept = store.read(meta, [*others, *hit]).join(rids, RID, "left_anti").select(*columns)
        if not mine.groupBy(*columns).count().filter("count > 1").isEmpty() or not mine.join(kept, list(columns), "left_semi").isEmpty():
            raise EngineError(message)
