"""The queries that stand for the engine's operators, each with the same query as DuckDB SQL.

Those that read the driver's tables run through the dialect or the operators; those that change tables copy a small dimension table
into a store of their own in the shared folder, change it there, and return what is left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.engine import Connection, Engine
from skerry.errors import EngineError
from skerry.operators import changes
from skerry.operators import relational as r

TABLES = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "labels": ()}
Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str, root: str | None = None) -> Engine:
    """An engine that knows the driver's tables."""
    e = Engine(spark, root)
    for name, key in TABLES.items():
        e.register(name, partial(r.scan, spark, sf_dir, name), key)
    return e


def _sql(text: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir).connect().query(text).frame


#: name -> (dialect, DuckDB; None where the text serves both)
SQL: dict[str, tuple[str, str | None]] = {
    "scan_full": ("select * from nation", None),
    "scan_pk_range": ("select o_orderkey, o_totalprice from orders where o_orderkey >= 100 and o_orderkey < 200", None),
    "scan_points": ("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey in (1, 7, 150, 99999999)", None),
    "scan_index_range": ("select c_custkey, c_nationkey from customer where c_nationkey >= 3 and c_nationkey < 9", None),
    "scan_range_algebra": ("select o_orderkey from orders where (o_orderkey <= 10 or o_orderkey > 14900) and o_orderkey <> 5 or o_orderkey between 500 and 510", None),
    "scan_reversed_literal": ("select o_orderkey from orders where 100 > o_orderkey and '20' <= o_orderkey", "select o_orderkey from orders where 100 > o_orderkey and 20 <= o_orderkey"),
    "filter_residual": ("select o_orderkey, o_totalprice from orders where o_orderkey < 1000 and o_totalprice > 150000.0", None),
    "filter_or": ("select c_custkey from customer where c_nationkey = 3 or c_acctbal > 5000.0", None),
    "filter_truthy": ("select n_nationkey, n_name from nation where n_regionkey", "select n_nationkey, n_name from nation where n_regionkey <> 0"),
    "project_expr": ("select o_orderkey + 1, o_orderkey, o_totalprice * 2.0 twice, 7 - o_custkey, -o_custkey neg from orders", "select o_orderkey + 1 as _1, o_orderkey, o_totalprice * 2.0 as twice, 7 - o_custkey as _2, -o_custkey as neg from orders"),
    "no_from": ("select 1 + 1, 7 / 2, concat('a', 1, NULL), length('abc')", "select cast(2 as bigint) as _0, cast(3 as bigint) as _1, 'a1NULL' as _2, cast(3 as bigint) as _3"),
    "int_div": ("select p_partkey, p_size / 7 q, (7 - p_size) / 3 neg, p_partkey / (p_size - 5) z from part", "select p_partkey, cast(p_size // 7 as bigint) q, cast((7 - p_size) // 3 as bigint) neg, cast(p_partkey // nullif(p_size - 5, 0) as bigint) z from part"),
    "float_div_zero": ("select n_nationkey, (n_nationkey - 5) / (n_regionkey * 1.0) x from nation where n_nationkey <> 5 or n_regionkey <> 0", "select n_nationkey, case when n_regionkey = 0 then case when n_nationkey > 5 then cast('inf' as double) when n_nationkey < 5 then cast('-inf' as double) else cast('nan' as double) end else (n_nationkey - 5) / cast(n_regionkey as double) end x from nation where n_nationkey <> 5 or n_regionkey <> 0"),
    "coerce_compare": ("select count(*) n from documents where lang = 5 or source <> 0", "select count(*) n from documents where try_cast(lang as double) = 5 or try_cast(source as double) <> 0"),
    "pred_as_int": ("select o_orderkey, o_totalprice > 100000.0 big, not o_orderstatus = 'F' open from orders", "select o_orderkey, cast(o_totalprice > 100000.0 as int) big, cast(not (o_orderstatus = 'F') as int) open from orders"),
    "in_list": ("select n_name from nation where n_regionkey in (1, 3)", None),
    "not_in_list": ("select n_name from nation where n_regionkey not in (1, 3)", None),
    "between": ("select p_partkey from part where p_size between 10 and 20", None),
    "not_between": ("select p_partkey from part where p_size not between 10 and 40", None),
    "like": ("select p_partkey from part where p_name like '%r_d%' and p_brand not like '%2'", None),
    "case_simple": ("select n_nationkey, case n_regionkey when 0 then 'zero' when 1 then 'one' else 'more' end kind from nation", None),
    "case_searched": ("select o_orderkey, case when o_totalprice > 200000.0 then 'high' when o_totalprice > 100000.0 then 'mid' end kind from orders", None),
    "is_null": ("select n_nationkey, nullif(n_regionkey, 1) is null missing from nation where nullif(n_regionkey, 2) is not null", "select n_nationkey, cast(nullif(n_regionkey, 1) is null as int) missing from nation where nullif(n_regionkey, 2) is not null"),
    "not_expr": ("select n_nationkey from nation where not (n_regionkey = 1 or n_nationkey > 20)", None),
    "in_subquery": ("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000.0)", None),
    "not_in_subquery": ("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)", None),
    "join_inner": ("select o.o_orderkey, c.c_name, o.o_totalprice from orders o inner join customer c on o.o_custkey = c.c_custkey", None),
    "join_left": ("select o.o_orderkey, l.l_quantity from orders o left join lineitem l on o.o_orderkey = l.l_orderkey", None),
    "join_right": ("select l.l_partkey, o.o_orderkey from lineitem l right outer join orders o on o.o_orderkey = l.l_orderkey and l.l_quantity > 25", None),
    "join_cross_on": ("select n.n_name, r.r_name from nation n cross join region r on n.n_regionkey = r.r_regionkey", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey"),
    "join_theta": ("select n.n_nationkey, r.r_regionkey from nation n join region r on n.n_regionkey > r.r_regionkey", None),
    "join_composite": ("select l.l_orderkey, l.l_partkey, o.o_custkey from lineitem l join orders o on l.l_orderkey = o.o_orderkey and l.l_linenumber = o.o_custkey % 7", None),
    "join_residual": ("select o.o_orderkey, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey and c.c_acctbal > 0.0 and o.o_totalprice > 100000.0", None),
    "join_self": ("select a.n_name, b.n_name other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "join_derived": ("select c.c_custkey, t.n from customer c join (select o_custkey k, count(*) n from orders group by o_custkey) t on c.c_custkey = t.k where t.n > 10", "select c.c_custkey, t.n from customer c join (select o_custkey k, count(*) n from orders group by o_custkey) t on c.c_custkey = t.k where t.n > 10"),
    "join_three": ("select r.r_name, count(*) n from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name", None),
    "agg_global": ("select count(*) n, sum(o_custkey) s, min(o_orderkey) lo, max(o_orderkey) hi from orders", "select count(*) n, cast(sum(o_custkey) as bigint) s, min(o_orderkey) lo, max(o_orderkey) hi from orders"),
    "agg_global_empty": ("select count(*) n, sum(o_custkey) s from orders where o_orderkey < 0", "select count(*) n, cast(sum(o_custkey) as bigint) s from orders where o_orderkey < 0"),
    "agg_group": ("select l_returnflag, count(*) c, sum(l_quantity) q from lineitem where l_orderkey > 0 group by l_returnflag having count(1) > 2", None),
    "agg_having": ("select o_custkey, count(*) n from orders group by o_custkey having count(*) > 12", None),
    "agg_expr": ("select count(o_orderkey) + 999, sum(o_custkey) / count(*) m from orders", "select count(o_orderkey) + 999 as _1, cast(sum(o_custkey) // count(*) as bigint) m from orders"),
    "agg_group_expr": ("select o_orderkey / 1000 k, count(*) n from orders group by o_orderkey / 1000", "select cast(o_orderkey // 1000 as bigint) k, count(*) n from orders group by 1"),
    "agg_count_nulls": ("select count(nullif(n_regionkey, 1)) n, count(*) every from nation", None),
    "agg_distinct": ("select o_orderstatus, count(distinct o_custkey) n, sum(distinct o_custkey) s from orders group by o_orderstatus", "select o_orderstatus, count(distinct o_custkey) n, cast(sum(distinct o_custkey) as bigint) s from orders group by o_orderstatus"),
    "agg_group_null": ("select nullif(n_regionkey, 1) k, count(*) n from nation group by nullif(n_regionkey, 1)", None),
    "agg_last_row": ("select o_custkey, o_totalprice, count(*) n from orders group by o_custkey", "select o_custkey, arg_max(o_totalprice, o_orderkey) o_totalprice, count(*) n from orders group by o_custkey"),
    "order_asc_nulls": ("select n_nationkey, nullif(n_regionkey, 0) k from nation order by nullif(n_regionkey, 0)", "select n_nationkey, nullif(n_regionkey, 0) k from nation order by nullif(n_regionkey, 0) nulls last, n_nationkey"),
    "order_desc_nulls": ("select n_nationkey, nullif(n_regionkey, 4) k from nation order by nullif(n_regionkey, 4) desc", "select n_nationkey, nullif(n_regionkey, 4) k from nation order by nullif(n_regionkey, 4) desc nulls last, n_nationkey"),
    "order_multi_key": ("select o_orderkey, o_orderstatus from orders order by o_orderstatus desc, o_custkey, o_orderkey", None),
    "order_by_alias": ("select o_custkey k, count(*) n from orders group by o_custkey order by n desc, k limit 20", None),
    "order_by_aggregate": ("select o_custkey from orders group by o_custkey having count(*) > 1 order by sum(o_totalprice) desc, o_custkey limit 20", None),
    "limit_scan": ("select count(*) n from (select o_orderkey from orders limit 7) t", None),
    "star_of_table": ("select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey", None),
    "modulo": ("select o_orderkey, o_custkey % 7 m, (0 - o_custkey) % 5 neg, o_orderkey % (o_custkey % 2) z from orders", "select o_orderkey, o_custkey % 7 as m, (0 - o_custkey) % 5 as neg, o_orderkey % nullif(o_custkey % 2, 0) as z from orders"),
    "not_in_subquery_nulls": ("select n_nationkey, n_name from nation where n_nationkey > 3 and n_nationkey not in (select nullif(r_regionkey, 9) from region) and n_nationkey not in (select o_custkey from orders where o_orderkey < 0)", "select n_nationkey, n_name from nation where n_nationkey > 3 and n_nationkey not in (select r_regionkey from region)"),
    "not_in_subquery_unknown": ("select count(*) n from nation where n_nationkey not in (select nullif(r_regionkey, 2) from region)", "select count(*) n from nation where n_nationkey not in (select nullif(r_regionkey, 2) from region)"),
    "union_chained": ("select n_nationkey k, n_name s from nation where n_nationkey < 3 union all select r_regionkey, r_name from region union select n_nationkey, n_name from nation where n_nationkey in (1, 2)", "select n_nationkey k, n_name s from nation where n_nationkey < 3 union all (select r_regionkey, r_name from region union select n_nationkey, n_name from nation where n_nationkey in (1, 2))"),
    "union_arms_ordered": ("select o_orderkey k from orders order by o_totalprice desc, o_orderkey limit 5 union all select c_custkey from customer order by c_acctbal, c_custkey limit 5", "(select o_orderkey k from orders order by o_totalprice desc, o_orderkey limit 5) union all (select c_custkey from customer order by c_acctbal, c_custkey limit 5)"),
    "fn_version": ("select version() like '%.%' v", "select cast(1 as int) v"),
    "top_k": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10", None),
    "limit_offset": ("select o_orderkey from orders order by o_orderkey limit 10 offset 25", None),
    "union_all": ("select n_regionkey k from nation union all select r_regionkey from region", None),
    "union_distinct": ("select n_regionkey k from nation union select r_regionkey from region", None),
    "select_distinct": ("select distinct o_orderstatus, o_orderpriority from orders", None),
    "cte": ("with big as (select o_custkey, count(*) n from orders group by o_custkey) select count(*) c, max(n) m from big", None),
    "cte_renamed": ("with a(k, n) as (select o_custkey, count(*) from orders group by o_custkey), b as (select max(n) top from a) select a.k, a.n from a join b on a.n = b.top", None),
    "derived_table": ("select t.k, t.n + 1 m from (select n_regionkey k, count(*) n from nation group by n_regionkey) t where t.n > 1", None),
    "fn_length": ("select doc_id, length(text) n from documents", "select doc_id, cast(strlen(text) as bigint) n from documents"),
    "fn_concat": ("select n_nationkey, concat(n_name, '-', nullif(n_regionkey, 1), 1.0) s from nation", "select n_nationkey, n_name || '-' || coalesce(cast(nullif(n_regionkey, 1) as varchar), 'NULL') || '1' s from nation"),
}


# ---- changes, on copies of small tables

NATION = "create table nation { n_nationkey int primary key auto_increment, n_name varchar(64) not null, n_regionkey int default 7 index by_region(n_regionkey) }"
REGION = "create table region { r_regionkey int primary key, r_name varchar(64) }"


def _shared(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that driver and executors share, deleted when the application ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{shared or tempfile.mkdtemp(prefix='skerry-')}/{kind}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _stored(spark: SparkSession, sf_dir: str) -> Connection:
    """A connection to fresh copies of nation and region."""
    e = Engine(spark, _shared(spark, "store"))
    db = e.connect()
    db.execute(NATION.replace(" auto_increment", ""))
    db.execute(REGION)
    for name in ("nation", "region"):
        changes.insert_frame(e.store, name, r.scan(spark, sf_dir, name).select(*e.store.meta(name).names))
    return db


def _changed(*statements: str, final: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _stored(spark, sf_dir)
        for s in statements:
            db.execute(s)
        return db.query(final).frame

    return query


def _refused(*statements: str) -> Query:
    """What the engine says to statements that it refuses, and that nothing has changed."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db, said = _stored(spark, sf_dir), []
        for k, s in enumerate(statements):
            try:
                db.query(s).rows() if s.startswith("select") else db.execute(s)
                said.append((k, "accepted"))
            except EngineError as e:
                said.append((k, str(e)))
        left = db.query("select count(*) + sum(n_nationkey) from nation").frame.toDF("left")
        return spark.createDataFrame(said, "k int, message string").crossJoin(F.broadcast(left))

    return query


def _refusals(*messages: str) -> str:
    rows = ", ".join(f"({k}, '{m}')" for k, m in enumerate(messages))
    return f"select cast(k as int) k, message, (select cast(count(*) + sum(n_nationkey) as bigint) from nation) as left from (values {rows}) t(k, message)"


_N = "cast(n_nationkey as bigint) n_nationkey, n_name, cast(n_regionkey as bigint) n_regionkey"
CHANGES: dict[str, tuple[Query, str]] = {
    "dml_insert": (_changed("insert into nation(n_nationkey, n_name) values (100, 'A'), (101, 'B')", "insert into nation(n_nationkey, n_name, n_regionkey) values (102, concat('C', 1), 1 + 1)", final="select * from nation"), f"select {_N} from nation union all values (100, 'A', 7), (101, 'B', 7), (102, 'C1', 2)"),
    "dml_delete": (_changed("delete from nation where n_regionkey = 1", final="select * from nation"), f"select {_N} from nation where n_regionkey <> 1"),
    "dml_delete_top": (_changed("delete from nation order by n_name desc limit 5", final="select * from nation"), f"select {_N} from nation where n_nationkey not in (select n_nationkey from nation order by n_name desc, n_nationkey limit 5)"),
    "dml_multi_delete": (_changed("delete nation, region from nation join region on nation.n_regionkey = region.r_regionkey where region.r_regionkey > 2", final="select n_name s from nation union all select r_name from region"), "select n_name s from nation where n_regionkey <= 2 union all select r_name from region where r_regionkey <= 2"),
    "dml_update": (_changed("update nation set n_regionkey = n_regionkey + 10, n_name = concat(n_name, n_regionkey) where n_nationkey < 10", final="select * from nation"), "select cast(n_nationkey as bigint) n_nationkey, case when n_nationkey < 10 then n_name || (n_regionkey + 10) else n_name end n_name, cast(case when n_nationkey < 10 then n_regionkey + 10 else n_regionkey end as bigint) n_regionkey from nation"),
    "dml_multi_update": (_changed("update nation n join region r on n.n_regionkey = r.r_regionkey set n.n_name = r.r_name, r.r_name = 'seen' where r.r_regionkey < 2", final="select n_name s from nation union all select r_name from region"), "select case when r_regionkey < 2 then r_name else n_name end s from nation join region on n_regionkey = r_regionkey union all select case when r_regionkey < 2 then 'seen' else r_name end from region"),
    "dml_move_key": (_changed("update nation set n_nationkey = n_nationkey + 1000 where n_regionkey = 3", final="select * from nation"), "select cast(case when n_regionkey = 3 then n_nationkey + 1000 else n_nationkey end as bigint) n_nationkey, n_name, cast(n_regionkey as bigint) n_regionkey from nation"),
    "dml_self_delete": (_changed("delete a, b from nation a join nation b on a.n_nationkey + 1 = b.n_nationkey where a.n_nationkey = 3 or a.n_nationkey = 8", final="select * from nation"), f"select {_N} from nation where n_nationkey not in (3, 4, 8, 9)"),
    "dml_self_update": (_changed("update nation a join nation b on a.n_nationkey + 1 = b.n_nationkey set a.n_name = 'first', b.n_regionkey = 77, b.n_name = concat(b.n_name, '!') where a.n_nationkey in (3, 8)", final="select * from nation"), "select cast(n_nationkey as bigint) n_nationkey, case when n_nationkey in (3, 8) then 'first' when n_nationkey in (4, 9) then n_name || '!' else n_name end n_name, cast(case when n_nationkey in (4, 9) then 77 else n_regionkey end as bigint) n_regionkey from nation"),
    "dml_update_top": (_changed("update nation set n_regionkey = 50 order by n_name desc limit 4", final="select * from nation"), f"select n_nationkey, n_name, case when n_nationkey in (select n_nationkey from nation order by n_name desc, n_nationkey limit 4) then 50 else n_regionkey end n_regionkey from (select {_N} from nation)"),
    "dml_delete_using": (_changed("delete from nation using nation join region on nation.n_regionkey = region.r_regionkey where region.r_regionkey < 2", final="select * from nation"), f"select {_N} from nation where n_regionkey >= 2"),
    "dml_auto_increment": (_changed("create table t { id int primary key auto_increment, v varchar(9) }", "insert into t(v) values ('a'), ('b')", "insert into t(id, v) values (9, 'c'), (NULL, 'd')", final="select * from t"), "select * from (values (cast(1 as bigint), 'a'), (2, 'b'), (9, 'c'), (4, 'd')) t(id, v)"),
    "dml_script": (_changed("insert into nation(n_nationkey, n_name) values (300, 'x'); update nation set n_name = 'y' where n_nationkey = 300; delete from nation where n_nationkey < 20;", final="select * from nation"), f"select {_N} from nation where n_nationkey >= 20 union all values (300, 'y', 7)"),
    "dml_unique_violations": (_refused("insert into nation(n_nationkey, n_name) values (3, 'again')", "insert into nation(n_nationkey, n_name) values (900, 'x'), (900, 'y')", "update nation set n_nationkey = 1 where n_nationkey = 2", "insert into nation(n_nationkey) values (901)"), _refusals("Duplicated primary key, must be unique.", "Duplicated primary key, must be unique.", "Duplicated primary key, in table: nation", "Column: n_name must not be null in table: nation")),
    "refused_queries": (_refused("select n_name from nation group by n_name", "select sum(count(n_nationkey)) from nation", "select nope(n_name) from nation", "select length(n_name) from nation union all select n_name from nation", "select n_name from nation union all select n_name, n_nationkey from nation", "select gone from nation"), _refusals("Group by clause without aggregator", "Nested aggregate function", "UDF: nope not found in this env.", "Column not compatible in column[0], left is bigint, but right is string", "Different number of columns, left is 1, but right is 2", "Unresolved symbol: gone")),
    "ddl_drop_table": (_refused("drop table region", "select r_name from region", "drop table region", "drop table if exists region"), _refusals("accepted", "Table: region not found", "Table `region` not found", "accepted")),
    "ddl_add_column": (_changed("alert table nation add column extra int not null default 4 first", "alert table nation add column note varchar(9) after n_nationkey", final="select * from nation"), "select cast(4 as bigint) extra, cast(n_nationkey as bigint) n_nationkey, cast(null as varchar) note, n_name, cast(n_regionkey as bigint) n_regionkey from nation"),
    "ddl_change_column": (_changed("alert table nation change column n_regionkey region varchar(9)", final="select * from nation"), "select cast(n_nationkey as bigint) n_nationkey, n_name, cast(n_regionkey as varchar) region from nation"),
    "ddl_modify_column": (_changed("alert table nation modify column n_regionkey double", final="select n_nationkey, n_regionkey from nation"), "select cast(n_nationkey as bigint) n_nationkey, cast(n_regionkey as double) n_regionkey from nation"),
    "ddl_drop_column": (_changed("drop index by_region on nation", "alert table nation drop column n_regionkey", final="select * from nation"), "select cast(n_nationkey as bigint) n_nationkey, n_name from nation"),
    "ddl_default_and_rename": (_changed("alert table nation alert column n_regionkey set default 3 + 5", "insert into nation(n_nationkey, n_name) values (200, 'x')", "alert table nation alert column n_regionkey drop default", "insert into nation(n_nationkey, n_name) values (201, 'y')", "alert table nation rename to land", final="select * from land where n_nationkey >= 200"), "select * from (values (cast(200 as bigint), 'x', cast(8 as bigint)), (201, 'y', null)) t(n_nationkey, n_name, n_regionkey)"),
    "ddl_indexes": (_changed("create index by_name on nation(n_name)", "create unique index by_both on nation(n_name, n_nationkey)", "drop index by_name on nation", final="select count(*) n from nation where n_name >= 'N'"), "select count(*) n from nation where n_name >= 'N'"),
}


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).connect().prepare("select o_orderkey, ? label from orders where o_orderkey between ? and ?").bind(0, "x").bind(1, 10).bind(2, 20).query().frame


def prepared_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared INSERT, UPDATE and DELETE, bound and run again with other values."""
    db = _stored(spark, sf_dir)
    add, turn, gone = db.prepare("insert into nation(n_nationkey, n_name, n_regionkey) values (?, ?, ?)"), db.prepare("update nation set n_name = ? where n_nationkey = ?"), db.prepare("delete from nation where n_regionkey = ?")
    for k, name in ((500, "p"), (501, "q")):
        add.bind(0, k).bind(1, name).bind(2, None).execute()
    turn.bind(0, "turned").bind(1, 500).execute()
    gone.bind(0, 2).execute()
    return db.query("select * from nation").frame


def script_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of several statements, read from a file."""
    db, path = _stored(spark, sf_dir), _shared(spark, "script")
    spark.createDataFrame([("delete from nation where n_regionkey = 0;\ncreate table t { a int };\ninsert into t(a) values (1), (2);",)], "value string").coalesce(1).write.text(path)
    db.execute_file(path)
    return db.query("select n_name s from nation union all select concat(a, '') from t").frame


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns as a result set's cursor hands them out."""
    found = engine(spark, sf_dir).connect().query("select n_nationkey, n_name from nation order by n_nationkey")
    return spark.createDataFrame(list(found), ", ".join(f"{n} {'string' if k == 'str' else k}" for n, k in found.columns))


def mock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation of given rows, joined with a table."""
    e = engine(spark, sf_dir)
    e.register("given", spark.createDataFrame([(1, "one"), (3, "three"), (None, "none")], "k bigint, word string"), ["k"])
    return e.connect().query("select g.word, r.r_name from given g left join region r on g.k = r.r_regionkey").frame


def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions by signature, over pandas Series and over single values."""
    e = engine(spark, sf_dir)
    e.register_udf("Doubled", lambda a: a * 2, "bigint->bigint")
    e.register_udf("shout", lambda s, n: None if s is None else s.upper() + "!" * n, "str,int->str", vector=False)
    return e.connect().query("select n_nationkey, doubled(n_nationkey) d, SHOUT(n_name, 2) s from nation").frame


def user_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of the user's, grouped and with HAVING and ORDER BY over them."""
    e = engine(spark, sf_dir)
    e.register_udaf("spread", lambda c: F.max(c) - F.min(c), "bigint->bigint")
    e.register_udaf("product_sum", lambda a, b: F.sum(a * b), "bigint,bigint->bigint")
    return e.connect().query("select o_orderstatus, spread(o_custkey) s, product_sum(o_custkey, o_orderkey % 10) + 1 p, count(*) n from orders group by o_orderstatus having spread(o_custkey) > 0 order by spread(o_custkey)").frame


def approx_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether HyperLogLog++ estimates of key cardinality are within a tenth of the exact ones."""
    orders, keys = r.scan(spark, sf_dir, "orders"), {"o_custkey": "customers", "o_orderkey": "orders"}
    # estimates and exact counts each on their own: together, Spark groups by the keys first, with the registers of both estimates (13 KB each) for every key
    found = orders.agg(*(F.approx_count_distinct(k, 0.01).alias(f"near_{k}") for k in keys))
    for k in keys:
        found = found.crossJoin(F.broadcast(orders.agg(F.count_distinct(F.col(k)).alias(f"exact_{k}"))))
    return found.select(*((F.abs(F.col(f"near_{k}") - F.col(f"exact_{k}")) <= 0.1 * F.col(f"exact_{k}")).alias(name) for k, name in keys.items()))


def op_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.between(r.scan(spark, sf_dir, "orders"), "o_orderkey", 100, 200, (False, True)).select("o_orderkey")


def op_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.points(r.scan(spark, sf_dir, "part"), "p_partkey", [1, 5, 999_999_999]).select("p_partkey", "p_name")


def op_renaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.renamed(r.scan(spark, sf_dir, "region"), "x", ["k", "name"])


def op_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.nothing(spark, "a bigint, b string")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: hourly counts by event type, as the streaming module makes them, over the table at rest."""
    from skerry.streaming.windows import counts

    return counts(r.scan(spark, sf_dir, "events"), "ts", "1 hour", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


OTHERS: dict[str, tuple[Query, str | None]] = {
    "prepared": (prepared, "select o_orderkey, 'x' label from orders where o_orderkey between 10 and 20"),
    "prepared_changes": (prepared_changes, "select cast(n_nationkey as bigint) n_nationkey, n_name, cast(n_regionkey as bigint) n_regionkey from nation where n_regionkey <> 2 union all values (500, 'turned', null), (501, 'q', null)"),
    "script_file": (script_file, "select n_name s from nation where n_regionkey <> 0 union all values ('1'), ('2')"),
    "result_cursor": (cursor, "select n_nationkey, n_name from nation"),
    "mock_rows": (mock_rows, "select word, r_name from (values (1, 'one'), (3, 'three'), (null, 'none')) g(k, word) left join region on k = r_regionkey"),
    "user_functions": (user_functions, "select n_nationkey, cast(n_nationkey * 2 as bigint) d, upper(n_name) || '!!' s from nation"),
    "user_aggregates": (user_aggregates, "select o_orderstatus, max(o_custkey) - min(o_custkey) s, cast(sum(o_custkey * (o_orderkey % 10)) as bigint) + 1 p, count(*) n from orders group by o_orderstatus having max(o_custkey) > min(o_custkey)"),
    "approx_cardinality": (approx_cardinality, "select true customers, true orders"),
    "op_range": (op_range, "select o_orderkey from orders where o_orderkey > 100 and o_orderkey <= 200"),
    "op_points": (op_points, "select p_partkey, p_name from part where p_partkey in (1, 5)"),
    "op_renaming": (op_renaming, "select r_regionkey k, r_name as name from region"),
    "op_empty": (op_empty, "select cast(1 as bigint) a, '' b where false"),
    "ext_tumbling_window": (tumbling, "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) n from events group by 1, 2"),
}


def queries() -> dict[str, Query]:
    return {n: _sql(mine) for n, (mine, _) in SQL.items()} | {n: q for n, (q, _) in (CHANGES | OTHERS).items()}


def oracle_sql() -> dict[str, str]:
    return {n: other or mine for n, (mine, other) in SQL.items()} | {n: s for n, (_, s) in (CHANGES | OTHERS).items() if s}
