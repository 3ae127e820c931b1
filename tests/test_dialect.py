"""The translation leaves standard SQL as it is: TPC-H through the engine gives what Spark gives."""

import pytest

from lodestone.__main__ import main
from lodestone.engine import Column, Engine, Table
from lodestone.plans import tpch
from lodestone.sources.tables import register_views

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def engine(spark):
    register_views(spark, "/root/testdata/sf0.001", TPCH_TABLES)
    e = Engine(spark)
    for n in TPCH_TABLES:
        e.tables[n] = Table("postgres", n, [Column(f.name, "text") for f in spark.table(n).schema.fields], "", True)
    return e


@pytest.mark.parametrize("name", sorted(tpch.SQL))
def test_tpch_through_the_engine(spark, engine, name):
    assert sorted(map(str, engine.run(tpch.SQL[name])[-1].collect())) == sorted(map(str, spark.sql(tpch.SQL[name]).collect()))


@pytest.mark.parametrize("sql,want", [
    ("select o_orderkey / 7, o_orderkey % 7 from postgres.orders where o_orderkey = 50", [[7, 1]]),
    ("select count(*) from orders where o_orderdate < date '1996-01-01' + interval '90' day", None),
    ("select sum(n_nationkey) / count(*) from nation", [[12]]),
    ("select n_regionkey, count(*) as c from nation group by n_regionkey having count(*) / 2 > 1 order by n_regionkey limit 1", [[0, 5]]),
    ("select case when n_nationkey / 10 = 1 then 'teens' else 'other' end as k, count(*) from nation group by k order by k", [["other", 15], ["teens", 10]]),
    ("select a.n_name from nation as a, nation as b where a.n_nationkey = b.n_nationkey + 1 and b.n_nationkey = 3", [["NATION_4"]]),
    ("select r_name from region where r_regionkey in (select n_regionkey from nation where n_nationkey in (1, 2)) order by 1", None),
    ("select 1 as \"Quoted\", - 2 * 3, -(4 - 6) / 2", [[1, -6, 1]]),
    ("select cast(3 as double precision) / 2, 3::float / 2, '12'::int / 5", [[1.5, 1.5, 2]]),
    ("select * from (values (1, 'a'), (2, null)) as v (x, y) where y is not null", [[1, "a"]]),
    ("select n_name from nation where n_name like 'NATION\\_1' or n_nationkey between 3 and 4 order by n_nationkey", None),
])
def test_statements(engine, sql, want):
    got = engine.query(sql)
    assert got and (want is None or got == want)


def test_shell_runs_files(spark, tmp_path, capsys):
    (tmp_path / "a.sql").write_text("create table shell_t (a int); insert into shell_t values (1), (null); select a from shell_t order by a; drop table shell_t")
    assert main(["-f", str(tmp_path / "a.sql"), "--output-format", "text"]) == 0
    assert capsys.readouterr().out.split() == ["2", "NULL", "1"]
    (tmp_path / "b.slt").write_text("query I\nselect 1\n----\n2\n")
    assert main(["-f", str(tmp_path / "b.slt")]) == 1
