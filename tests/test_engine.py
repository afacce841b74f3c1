"""The dialect end to end, on small tables with known answers."""

import pytest

from skerry.engine import Engine, header
from skerry.errors import EngineError, SyntaxProblem


@pytest.fixture()
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store")).connect()


def rows(db, sql):
    return db.query(sql).rows()


ORDERED = """create table t1 { id int primary key auto_increment, name varchar(255), nick char(9), factor float, `order` bigint not null };
insert into t1(name, nick, factor, `order`) values ("aaa","001",-0.1,10),("bbb","002",0.1,20),("aaa","003",0.2,30),("ccc","003",0.4,40),("xxx","010",0.001,50),("aaa",NULL,0.34,60),(NULL,"009",0.67,70),(NULL,"007",NULL,80);"""
PAIR = """create table t3 { id bigint primary key auto_increment, dd int, name varchar(255) index index_dd(dd) };
create table t4 { id bigint primary key auto_increment, df int, name varchar(255) key index_df(df) };
insert into t3(dd,name) values (100,"Js"),(101,"Jc"),(102,"Jk"),(102,"Ol");
insert into t4(df,name) values (101,"Js"),(101,"Jc"),(102,"Jk");"""
NINE = """create table t1 { id int primary key auto_increment, name varchar(255), a char(9), b int index idx_b(b) };
insert into t1(name,a,b) values ("a","xxx",200),("aa","xxx",300),("aa","xxx",301),("aaa","xxx",400),("aaaa","xxx",500),("aaaaa","xxx",600),("aaaaa","xxx",601),("aaaaa","xxx",602),("aaaaaa","xxx",700);"""


def test_defaults_and_auto_increment(db):
    db.execute("create table t1 { id int primary key auto_increment, name varchar(255) not null, ver varchar(255) default concat('hello', ',world'), nn int default 0 }")
    assert db.execute("insert into t1(name) values ('aaa'),('ccc'),('bbb')") == 3
    assert rows(db, "select * from t1 order by id") == [(1, "aaa", "hello,world", 0), (2, "ccc", "hello,world", 0), (3, "bbb", "hello,world", 0)]
    with pytest.raises(EngineError, match="not be null"):
        db.execute("insert into t1(nn) values (1)")
    db.execute("insert into t1(id, name) values (9, 'x'), (NULL, 'y')")
    assert [r[0] for r in rows(db, "select id from t1 order by id")] == [1, 2, 3, 5, 9]


def test_order_by(db):
    db.execute(ORDERED)
    ids = lambda sql: [r[0] for r in rows(db, sql)]
    assert ids("select id from t1 order by name desc") == [5, 4, 2, 1, 3, 6, 7, 8]
    assert ids("select id from t1 order by name desc, nick") == [5, 4, 2, 1, 3, 6, 8, 7]
    assert ids("select id from t1 order by name limit 3 offset 1") == [3, 6, 2]
    assert ids("select id from t1 order by case when id > 6 then 0 else 1, id desc") == [8, 7, 6, 5, 4, 3, 2, 1]
    assert rows(db, "select factor from t1 where id = 1") == [(-0.10000000149011612,)]
    assert db.execute("delete from t1 order by id desc limit 2") == 2 and ids("select id from t1 order by id") == [1, 2, 3, 4, 5, 6]
    assert db.execute("update t1 set factor = 0.0 order by id desc limit 2") == 2
    assert ids("select id from t1 where factor = 0 order by id") == [5, 6]


def test_schema_evolution(db):
    db.execute("""create table t1 { id int primary key, name varchar(255) not null, ver varchar(255) default concat('a','b'), nn int default 0 };
    insert into t1(id,name,ver,nn) values (1111,"hello","1.1",0),(2222,"aaa","1.2",1),(3333,"ccc","1.3",3),(4444,"demo","2.1",5)""")
    assert db.execute("alert table t1 change column id uid char(9) not null") == 4
    assert header(db.engine, "t1") == "|-uid:CHAR(9)-|-name:VARCHAR(255)-|-ver:VARCHAR(255)-|-nn:INT(11)-|"
    assert db.execute("alert table t1 modify column ver float") == 4
    assert rows(db, "select uid, ver from t1 where uid <= '3333' order by uid") == [("1111", 1.100000023841858), ("2222", 1.2000000476837158), ("3333", 1.2999999523162842)]
    db.execute("alert table t1 drop column nn")
    db.execute("alert table t1 drop column uid")
    assert rows(db, "select * from t1 where name = 'demo'") == [("demo", 2.0999999046325684)]
    db.execute("insert into t1(name) values ('new')")
    assert len(rows(db, "select * from t1")) == 5
    db.execute("alert table t1 alert column ver set default 1.5; insert into t1(name) values ('d'); alert table t1 alert column ver drop default; insert into t1(name) values ('e')")
    assert rows(db, "select name, ver from t1 where name in ('d','e') order by name") == [("d", 1.5), ("e", None)]
    db.execute("alert table t1 rename to t9")
    assert len(rows(db, "select * from t9")) == 7
    with pytest.raises(EngineError, match="not found"):
        db.query("select * from t1")


def test_joins(db):
    db.execute(PAIR)
    a, b, c, d = (1, 100, "Js"), (2, 101, "Jc"), (3, 102, "Jk"), (4, 102, "Ol")
    x, y, z = (1, 101, "Js"), (2, 101, "Jc"), (3, 102, "Jk")
    n = (None,) * 3
    get = lambda j: sorted(rows(db, f"select * from {j}"), key=str)
    assert get("t3 inner join t4 on t3.name = t4.name") == sorted([a + x, b + y, c + z], key=str)
    assert get("t3 join t4 on t3.dd = t4.df") == sorted([b + x, b + y, c + z, d + z], key=str)
    assert get("t3 left join t4 on t3.id = t4.id") == sorted([a + x, b + y, c + z, d + n], key=str)
    assert get("t4 right outer join t3 on t3.id = t4.id") == sorted([x + a, y + b, z + c, n + d], key=str)
    assert get("t3 cross join t4 on t3.id > t4.id and t4.id > 1") == sorted([c + y, d + y, d + z], key=str)
    assert rows(db, "select q.n, t3.dd from t3 join (select name n, count(*) c from t4 group by name) q on t3.name = q.n and q.c = 1 order by t3.id") == [("Js", 100), ("Jc", 101), ("Jk", 102)]


def test_changes_over_joins(db):
    db.execute(PAIR)
    assert db.execute('update t3 inner join t4 on t3.id = t4.id set t3.name="cc", t4.name="dd" where t4.df=101') == 4
    assert sorted(r[0] for r in rows(db, "select name from t4")) == ["Jk", "dd", "dd"] and sorted(r[0] for r in rows(db, "select name from t3")) == ["Jk", "Ol", "cc", "cc"]
    with pytest.raises(EngineError, match="Obscure assignment name"):
        db.execute("update t3 join t4 on t3.id = t4.id set name = 'x'")
    assert db.execute("update t3 join t4 on t3.dd = t4.df set t3.name = t4.id where t3.id = 2") == 4
    assert rows(db, "select name from t3 where id = 2") == [("2",)]
    assert db.execute("delete t3, t4 from t3 right join t4 on t3.id = t4.id where t3.id = 2") == 2
    assert [r[0] for r in rows(db, "select id from t4 order by id")] == [1, 3]
    assert db.execute("delete from t3 using t3 join t4 on t3.id = t4.id") == 2
    assert [r[0] for r in rows(db, "select id from t3")] == [4]


def test_single_table_changes(db):
    db.execute(NINE)
    assert db.execute('update t1 set name="bbb" where id=3') == 1 and rows(db, "select name from t1 where id=3") == [("bbb",)]
    assert db.execute('update t1 set id=30, name="cc" where id=3') == 1
    assert rows(db, "select * from t1 where id=30") == [(30, "cc", "xxx", 301)] and rows(db, "select * from t1 where id=3") == []
    db.execute("update t1 set b = b + 1, name = concat(b, '!') where id = 1")
    assert rows(db, "select name, b from t1 where id = 1") == [("201!", 201)]
    with pytest.raises(EngineError, match="Duplicated primary key, in table: t1"):
        db.execute("update t1 set id = 1 where id = 2")
    assert len(rows(db, "select * from t1 union all select * from t1")) == 18 and len(rows(db, "select * from t1 union select * from t1")) == 9
    assert db.execute("delete from t1") == 9 and rows(db, "select count(*) from t1") == [(0,)]


def test_columns_and_indexes(db):
    db.execute(NINE)
    assert db.execute("alert table t1 add column x varchar(8)") == 0
    db.execute("alert table t1 add column y int after a")
    assert db.execute("alert table t1 add column z int not null default 0 first") == 9
    assert db.query("select * from t1").names == ["z", "id", "name", "a", "y", "b", "x"]
    assert rows(db, "select * from t1 where id = 1") == [(0, 1, "a", "xxx", None, 200, None)]
    assert db.execute("create index i2 on t1(name)") == 9 and db.execute("drop index i2 on t1") == 9
    with pytest.raises(EngineError, match="index u is unique"):
        db.execute("create unique index u on t1(name)")
    db.execute("create unique index u on t1(b)")
    with pytest.raises(EngineError, match="Duplicated secondary key, index u is unique."):
        db.execute("insert into t1(b) values (700)")
    db.execute("drop table t1; drop table if exists t1; create table if not exists t1 { a int }; create table if not exists t1 { a int }")
    with pytest.raises(EngineError):
        db.execute("drop table t2")


def test_primary_keys(db):
    db.execute("create table t3 { part1 bigint, part2 int, part3 varchar(4), dt int constraint primary key(part1, part2, part3) }")
    db.execute("insert into t3(part1,part2,part3,dt) values (1,1,'a',0),(1,1,'b',0)")
    for sql in ("insert into t3(part1,part2,part3) values (1,1,'a')", "insert into t3(part1,part2,part3) values (2,1,'a'),(2,1,'a')"):
        with pytest.raises(EngineError, match="Duplicated primary key, must be unique."):
            db.execute(sql)
    assert rows(db, "select count(*) from t3") == [(2,)]
    with pytest.raises(EngineError, match="too long"):
        db.execute("insert into t3(part1,part2,part3) values (9,9,'abcde')")
    with pytest.raises(EngineError, match="is part of index PRIMARY"):
        db.execute("alert table t3 drop column part1")


def test_without_from(db):
    q = db.query("select 1 + 1, version(), length(), length('中文'), concat('a', 1, NULL, 1.0, 2.5), 7 / 2, -7/2, 1/0, 1.0/0, 'x' y")
    assert q.names == ["_0", "_1", "_2", "_3", "_4", "_5", "_6", "_7", "_8", "y"]
    assert q.rows() == [(2, q.rows()[0][1], None, 6, "a1NULL12.5", 3, -3, None, float("inf"), "x")]


def test_expressions(db):
    db.execute("create table t1 { a int primary key, b int, c varchar(64) }; insert into t1(a,b,c) values (1,22,'hello'),(2,NULL,'5'),(3,7,NULL),(4,0,'')")
    q = db.query("select a + 1, b - 20, a from t1 where a = 1")
    assert q.names == ["_1", "_2", "a"] and q.rows() == [(2, 2, 1)]
    ids = lambda where: sorted(r[0] for r in rows(db, f"select a from t1 where {where}"))
    assert ids("b between 1 and 22") == [1, 3] and ids("b not between 1 and 7") == [1, 4] and ids("b between 9 and 1") == []
    assert ids("b in (22, 7)") == [1, 3] and ids("b not in (22, 7)") == [4] and ids("b not in (22, NULL)") == []
    assert ids("b is null") == [2] and ids("c is not null and not a = 1") == [2, 4]
    assert ids("c") == [1, 2] and ids("b") == [1, 3] and ids("not b") == [4]
    assert ids("c = 5") == [2] and ids("a <= '2'") == [1, 2] and ids("a = 'x'") == [] and ids("a + 1 in (2, 3)") == [1, 2]
    assert ids("a > 3 or b = 22") == [1, 4] and ids("100 > a and a <> 2") == [1, 3, 4] and ids("c like 'he%'") == [1]
    assert ids("a in (select b - 21 from t1 where b is not null)") == [1] and ids("a not in (select b from t1)") == []
    assert rows(db, "select a > 2, case a when 1 then 'one' when 2 then 2 else 'more' end, case when b > 9 then 1 from t1 order by a") == [(0, "one", 1), (0, "2", None), (1, "more", None), (1, "more", None)]
    assert rows(db, "select distinct b is null from t1 order by b is null") == [(0,), (1,)]


def test_aggregates(db):
    db.execute("""create table t1 { id int primary key auto_increment, record int, name varchar(64) index idx_name(name) };
    insert into t1(record,name) values (1,'Jerry'),(2,'John'),(3,'Jerry'),(4,'Tom'),(5,'ST'),(6,'John'),(7,'Jerry'),(8,'Tom'),(9,'John'),(10,'Jerry')""")
    assert sorted(rows(db, "select name, count(*) from t1 group by name")) == [("Jerry", 4), ("John", 3), ("ST", 1), ("Tom", 2)]
    assert sorted(rows(db, "select name, count(1) n from t1 group by name having count(1) > 2")) == [("Jerry", 4), ("John", 3)]
    assert rows(db, "select count(id) + 999, sum(record), sum(distinct record / 5), count(distinct name) from t1") == [(1009, 55, 3, 4)]
    assert rows(db, "select count(*), sum(id) from t1 where id > 99") == [(0, None)]
    assert rows(db, "select name, record, count(*) c from t1 group by name order by c desc, name") == [("Jerry", 10, 4), ("John", 9, 3), ("Tom", 8, 2), ("ST", 5, 1)]
    assert rows(db, "with a(n, k) as (select name, count(*) from t1 group by name), b as (select k from a where n = 'ST') select a.n from a join b on a.k = b.k") == [("ST",)]
    for sql, message in (("select name from t1 group by name", "Group by clause without aggregator"), ("select sum(count(id)) from t1", "Nested"), ("select foo(id) from t1", "UDF: foo not found in this env."), ("select nope from t1", "Unresolved symbol: nope"), ("select id from t1 union all select name from t1", "Column not compatible"), ("select id, name from t1 union select id from t1", "Different number of columns"), ("select * from t1 limit 'x'", "Require integral literal")):
        with pytest.raises(EngineError, match=message):
            rows(db, sql)


def test_prepared(db):
    db.execute("create table t1 { id int primary key, name varchar(9), f double }")
    p = db.prepare("insert into t1(id, name, f) values (?, ?, ?), (?, 'x', NULL)")
    with pytest.raises(EngineError, match="Not all value bound"):
        p.execute()
    for i, v in enumerate((1, "a", 0.5, 2)):
        p.bind(i, v)
    assert p.execute() == 2
    q = db.prepare("select name, ? from t1 where id = ? limit ?").bind(0, 7).bind(1, 2).bind(2, 1)
    assert q.query().rows() == [("x", 7)] and list(q.query()) == [("x", 7)]
    assert db.prepare("update t1 set f = ? where id = ?").bind(0, None).bind(1, 1).execute() == 1
    with pytest.raises(EngineError, match="Not all value bound"):
        db.execute("select ?")


def test_scripts_functions_and_frames(db, spark, tmp_path):
    (tmp_path / "s.sql").write_text("create table t { a int };\ninsert into t(a) values (1), (2);\n")
    assert db.execute_file(str(tmp_path / "s.sql")) == 2
    db.engine.register_udf("Twice", lambda a: a * 2, "bigint->bigint")
    assert rows(db, "select twice(a) from t order by a") == [(2,), (4,)]
    db.engine.register("ext", spark.range(5).toDF("n"), ["n"])
    assert rows(db, "select sum(n) from ext where n > 1") == [(9,)]
    from skerry.operators.changes import insert_frame

    assert insert_frame(db.engine.store, "t", spark.range(3, 6).toDF("a")) == 3 and rows(db, "select count(*), sum(a) from t") == [(5, 15)]
    assert db.engine.store.names() == ["t"] and db.engine.store.clean("t") == 0
    with pytest.raises(EngineError, match="bad format"):
        db.engine.register_udf("x", lambda a: a, "date->int")


def test_snapshot_and_plans(db):
    db.execute(NINE)
    before = db.query("select count(*) from t1")
    db.execute("delete from t1 where id < 5")
    assert before.rows() == [(9,)] and rows(db, "select count(*) from t1") == [(5,)]
    plan = db.explain("select name from t1 where id >= 100 and id < '200'")
    assert "PushedFilters: [IsNotNull(c0), GreaterThanOrEqual(c0,100), LessThan(c0,200)]" in plan and "Python" not in plan


def test_two_writers(db):
    db.execute(NINE)
    store = db.engine.store
    one, two = store.meta("t1"), store.meta("t1")
    one.counter = 50
    store.commit(one)
    two.counter = 60
    with pytest.raises(EngineError, match="changed by another writer"):
        store.commit(two)
    assert store.meta("t1").counter == 50 and store.names() == ["t1"]


def test_changes_rewrite_only_files_that_hold_rows(db, spark):
    from skerry.operators.changes import insert_frame

    db.execute("create table t { a int primary key, b int }")
    for k in range(3):
        insert_frame(db.engine.store, "t", spark.range(100 * k, 100 * k + 100, 1, 2).selectExpr("id a", "id % 7 b"))
    before = set(db.engine.store.meta("t").folders)
    assert db.execute("update t set b = 100 where a between 130 and 140") == 11 and db.execute("delete from t where a = 250") == 1
    after = db.engine.store.meta("t").folders
    assert len(before & set(after)) == 1 and sum("/" in f for f in after) == 2
    assert rows(db, "select count(*), sum(a), count(distinct b), sum(b) from t") == [(299, sum(range(300)) - 250, 8, sum(100 if 130 <= a <= 140 else a % 7 for a in range(300) if a != 250))]
    assert db.engine.store.clean("t") == 2 and rows(db, "select count(*) from t") == [(299,)]
    with pytest.raises(EngineError, match="Duplicated primary key"):
        db.execute("update t set a = 299 where a = 5")
    assert db.execute("update t set a = a + 1000") == 299 and rows(db, "select min(a), max(a) from t") == [(1000, 1299)]
    assert db.execute("delete from t") == 299 and db.execute("delete from t") == 0 and db.execute("update t set b = 1") == 0


def test_one_table_under_two_names(db):
    db.execute(NINE)
    assert db.execute("update t1 x join t1 y on x.id + 1 = y.id set x.name = NULL, y.name = 'later', y.b = 9 where x.id in (1, 2)") == 4
    assert rows(db, "select id, name, b from t1 where id < 4 order by id") == [(1, None, 200), (2, "later", 9), (3, "later", 9)]
    assert db.execute("delete x, y from t1 x join t1 y on x.id + 1 = y.id where x.id > 6") == 3
    assert rows(db, "select count(*), max(id) from t1") == [(6, 6)]


@pytest.mark.parametrize("sql", ["select", "select 1 from", "selec 1", "select a from t where", "create table t (a int)", "insert into t values (1)", "select 'a", "select 1 union", "select a from t order a", "update t a = 1", "select * from t join u", "alter table t drop column a"])
def test_syntax_errors(db, sql):
    with pytest.raises(SyntaxProblem, match=r"^\[\d+:\d+\]"):
        db.execute(sql)
