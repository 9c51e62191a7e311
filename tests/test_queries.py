import pytest

import __spark_entry__ as entry
from sparktrail import plans

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_against_sql(spark, con, name):
    same(entry.queries()[name](spark, SF), con, plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 1


@pytest.mark.parametrize("name", ["recovery_report", "episode_summary", "agg_overview", "join_compare_releases"])
def test_order_and_partitions_of_the_input_do_not_matter(spark, tmp_path, name):
    import shutil

    for t in ("events", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(7).orderBy(*(["value"] if t == "events" else ["l_tax"])).write.parquet(str(tmp_path / f"{t}.parquet"))
    shutil.copy(f"{SF}/customer.parquet", tmp_path)
    q = entry.queries()[name]
    rows = lambda d: sorted(str(r) for r in q(spark, d).collect())
    assert rows(SF) == rows(str(tmp_path))
