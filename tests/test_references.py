from datetime import datetime

from pyspark.sql import functions as F

from conftest import tuples
from lodestack.operators import references as refs


def test_ids_and_links(spark):
    rows = spark.createDataFrame([(" 007\n",), ("12a",), ("",), (None,), ("000",), (" 42",)], "i string")
    assert [r[0] for r in rows.select(refs.clean_id(F.col("i"))).collect()] == ["7", None, None, None, "0", "42"]
    base = refs.WIKI_BASE
    links = [f"{base}/pages/viewpage.action?spaceKey=A&pageId=0012", "/spaces/A/pages/7/T", f" {base}/spaces/x/pages/1/x?pageId=9#top ", "https://docs.example/pages/3", "/x/1", "#top", None, f"{base}/pages/abc?pageId="]
    got = spark.createDataFrame([(x,) for x in links], "l string").select(refs.link_target(F.col("l"))).collect()
    assert [r[0] for r in got] == ["12", "7", "9", None, None, None, None, None]


def test_times(spark):
    texts = ["2024-01-03T00:25:40.420178Z", "2024-01-04T06:40:02.671487+02:00", "2024-01-02 16:24:32.2", "2024-01-01T00:00:00", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(refs.sync_time(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-03 00:25:40", "2024-01-04 04:40:02", "2024-01-02 16:24:32", "2024-01-01 00:00:00", None, None]


def states(spark):
    pages = [("0001", 1, "current", "2024-01-01T00:00:00"), ("1", 2, None, "2024-03-01T00:00:00"), ("2", 2, " DELETED ", "2024-01-01T00:00:00"), ("2", 1, "current", "2024-01-02T00:00:00"), ("3", 1, "current", "2024-06-01T00:00:00"), ("x", 1, "current", None), (None, None, None, None)]
    return refs.page_states(spark.createDataFrame(pages, "page_id string, version int, status string, synced_at string"))


def test_reasons_and_report(spark):
    at = datetime(2024, 2, 1)
    rows = [("t", "f", "a", "1", at), ("t", "f", "b", "2", at), ("t", "f", "c", "3", at), ("t", "f", "d", "9", at), ("t", "f", "d", "9", at), ("t", "f", "e", None, at), ("t", "f", "g", "3", None), ("t", "f", "h", "9", None)]
    df = spark.createDataFrame(rows, "ref_table string, ref_field string, ref_key string, target_page_id string, ref_time timestamp").withColumn("removed", F.lit("clash"))
    want = [("b", "deleted", "2024-02"), ("c", "late", "2024-02"), ("d", "missing", "2024-02"), ("h", "missing", None)]
    for share in (0.001, 0.3, 2.0):  # all keys heavy, some, none
        got = refs.orphan_references(df, states(spark), share)
        assert tuples(got, "ref_key", "reason", "ref_month") == want
        assert tuples(refs.orphan_report(df, states(spark), share), "reason", "ref_month", "n_orphans") == [("deleted", "2024-02", 1), ("late", "2024-02", 1), ("missing", "2024-02", 1), ("missing", None, 1)]
    assert refs.orphan_references(df.where("false"), states(spark)).count() == 0
    assert refs.orphan_references(df, states(spark).where("false")).count() == 6


def test_months_of_which_a_part_is_late(spark):
    rows = [("t", "f", str(i), "3", datetime(2024, m, d)) for i, (m, d) in enumerate([(5, 1), (5, 30), (6, 1), (6, 2), (7, 1)])] + [("t", "f", "5", "3", datetime(2024, 5, 31)), ("t", "f", "5", "3", datetime(2024, 5, 1)), ("t", None, None, "3", datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "ref_table string, ref_field string, ref_key string, target_page_id string, ref_time timestamp")
    pages = spark.createDataFrame([("3", 1, "current", "2024-05-31T00:00:00")], "page_id string, version int, status string, synced_at string")
    for share in (0.001, 2.0):
        assert tuples(refs.orphan_references(df, refs.page_states(pages), share), "ref_key", "reason") == [("", "late"), ("0", "late"), ("1", "late"), ("5", "late")]
        assert tuples(refs.orphan_report(df, refs.page_states(pages), share), "ref_month", "n_orphans") == [("2024-01", 1), ("2024-05", 3)]


def test_hot_target_is_split_off(spark):
    hot = spark.range(3000).select(F.lit("t").alias("ref_table"), F.lit("f").alias("ref_field"), F.col("id").cast("string").alias("ref_key"), F.when(F.col("id") % 3 == 0, "77").otherwise(F.col("id").cast("string")).alias("target_page_id"), F.timestamp_seconds("id").alias("ref_time"))
    got = refs.orphan_references(hot, states(spark), 0.1)
    assert got.where("target_page_id = '77' AND reason = 'missing'").count() == 1001
    assert got.select("ref_key").distinct().count() == got.count() >= 2990
