"""Pages by counted ranges against sorted lists."""

import random

import pytest

from railweave.sources import tables as src


def rows(n=5000):
    rng = random.Random(6)
    # a third of the rows has one key, some have none
    return [(None if i % 17 == 0 else "hub" if i % 3 == 0 else f"k{rng.randrange(900):03d}", rng.randrange(40) if i % 11 else None, i) for i in range(n)]


def order(r):
    return tuple((x is not None, x if x is not None else 0 if k else "") for k, x in enumerate(r))


@pytest.mark.parametrize("start, end", [(0, 7), (290, 310), (1000, 1100), (2500, 2700), (4990, 5100), (6000, 6100)])
def test_pages(spark, start, end):
    data = rows()
    df = spark.createDataFrame(data, "a string, b int, c int").repartition(7)
    got = src.rows_between(df, ["a", "b", "c"], start, end, sorted_rows=50)
    assert [tuple(r) for r in got.collect()] == sorted(data, key=order)[start:end]


def test_equal_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1)] * 3000 + [("y", 2)], "a string, b int")
    assert src.rows_between(df, ["a"], 100, 110, sorted_rows=10).count() == 10 and src.rows_between(df, ["a"], 2999, 3010, sorted_rows=10).collect()[-1].a == "y"
    assert src.page_table(df.limit(0), "a").collect() == [] and src.slice_rows(df, "a", 5, 5).collect() == []


def test_a_deep_page_is_not_a_sort_of_the_table(spark):
    """Only the ranges of the page are read on, and the cuts reach the scan as filters."""
    df = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    page = src.page_table(df, ["l_orderkey", "l_linenumber"], 100, 500_000)
    assert page.count() == 100 and page.first().total == df.count()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), GreaterThanOrEqual(l_orderkey" in plan
    want = [tuple(r) for r in df.orderBy("l_orderkey", "l_linenumber").limit(500_100).offset(500_000).select("l_orderkey", "l_linenumber").collect()]
    assert [tuple(r) for r in page.select("l_orderkey", "l_linenumber").collect()] == want


def rows_read(df):
    """Rows that the scan of a query that has run handed on."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_lookups_skip_row_groups(spark, tmp_path):
    """By statistics for the sorted key, by Bloom filters for the others; nothing is missed."""
    root = str(tmp_path / "store")
    rows = [("trains", i, f"{10000 + i * 7919 % 40_000}", None, "x" * 60) for i in range(40_000)] + [("stations", 10**6 + i, None, f"C{i}", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "collection string, doc_id long, train_no string, station_code string, content string").repartition(2)
    src.write_collection(df, root, block_bytes=1 << 16)
    for column, value, of in (("doc_id", 31_234, "trains"), ("train_no", rows[31_234][2], "trains"), ("station_code", "C77", "stations")):
        found = src.point_lookup(src.read_collection(spark, root, of), column, value)
        assert [r[column] for r in found.collect()] == [value]
        assert rows_read(found) < (8000 if of == "trains" else 301), (column, rows_read(found))
    absent = src.point_lookup(src.read_collection(spark, root, "trains"), "train_no", "no such")
    assert absent.collect() == [] and rows_read(absent) < 2000
