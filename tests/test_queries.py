import hashlib

import duckdb
import pytest

from lumenfold.operators import cov
from lumenfold.plans import binned
from lumenfold.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    number = lambda v: round(float(v), 6) if isinstance(v, float | int) and not isinstance(v, bool) else v
    return sorted(str(sorted((k, number(v)) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    want = con.execute(plans.oracle_sql()[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in plans.queries()[name](spark, sf_dir).collect()]
    assert got and plain(got) == plain(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    plan = plans.queries()["hist_weighted_2d"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_shipdate" not in plan.split("ReadSchema")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_overlap_of_an_order_with_many_items(spark, sf_dir, tmp_path):
    """An event of more than 1001 items: the SQL counts all of them."""
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    key = c.execute(f"select min(l_orderkey) from '{sf_dir}/lineitem.parquet'").fetchone()[0]
    c.execute(f"""copy (select * from '{sf_dir}/lineitem.parquet' union all
      select t.* replace (i::int + 100 as l_linenumber, 1 + i % 50 as l_quantity, 100 + i as l_extendedprice) from (select * from '{sf_dir}/lineitem.parquet' where l_orderkey = {key} limit 1) t, range(1500) r(i)) to '{tmp_path}/lineitem.parquet'""")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    c.execute(f"copy (select * from '{sf_dir}/orders.parquet') to '{tmp_path}/orders.parquet'")
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    want = c.execute(plans.oracle_sql()["delta_r_overlap"]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in plans.queries()["delta_r_overlap"](spark, str(tmp_path)).collect()]
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["backgrounds_gamma_rho", "fold_closure", "fold_shifted_truth", "fold_error_propagation"])
def test_the_fold_reads_its_table_once(spark, sf_dir, name):
    """All roles come from one aggregation of the items; error propagation has one more for the squares."""
    df = plans.queries()[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert 1 <= final.count("FileScan") <= 2


@pytest.mark.parametrize("name", ["bootstrap_poisson", "fold_bootstrap"])
def test_a_draw_is_hashed_once(spark, sf_dir, name):
    """The hash is a column that comparisons refer to, so no sum computes it anew."""
    df = plans.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "md5(" in line]
    assert lines and not any("Aggregate" in line or "conv(" in line for line in lines)
    assert all(line.count("md5(") == (1 if name == "bootstrap_poisson" else binned._REPLICAS) for line in lines)


@pytest.mark.parametrize("name", ["bootstrap_poisson", "fold_bootstrap"])
def test_bootstrap_of_events_without_id_and_of_many_items(spark, sf_dir, tmp_path, name):
    """A null id has no hash and counts as the tail, as in the SQL; an event may lie in all cells."""
    c = duckdb.connect()
    key = c.execute(f"select min(l_orderkey) from '{sf_dir}/lineitem.parquet'").fetchone()[0]
    c.execute(f"""copy (select * replace (case when l_orderkey % 5 = 0 then null when l_orderkey % 3 = 0 then {key} else l_orderkey end as l_orderkey)
      from '{sf_dir}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'""")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = c.execute(plans.oracle_sql()[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in plans.queries()[name](spark, str(tmp_path)).collect()]
    assert got and plain(got) == plain(want)


def test_a_draw_follows_the_hash(spark):
    """Bounds written in hexadecimal say what numbers would, at the bounds too."""
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    numbers = [0, 2**32 - 1, *(int(b * 2**32) + k for b in bounds for k in (-1, 0, 1, 2))]
    df = spark.createDataFrame([(n, f"{n:08x}" + "0" * 24) for n in numbers], "n long, h string")
    assert {r.n: r.k for r in df.select("n", cov.poisson("h").alias("k")).collect()} == {n: sum(n / 2**32 >= b for b in bounds) for n in numbers}
    md5 = spark.createDataFrame([(17, 3), (None, 3)], "e long, r int").select(cov.hashed("e", "r").alias("h"), cov.poisson(cov.hashed("e", "r")).alias("k")).collect()
    assert md5[0].h == hashlib.md5(b"17:3").hexdigest() and tuple(md5[1]) == (None, 7)
