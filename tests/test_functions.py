import hashlib
import uuid

from pyspark.sql import functions as F

from conftest import tuples
from lodestack.functions import text as fx

BASE = "https://w"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_url_to_id(spark):
    got = one(spark, *(fx.url_to_id(F.lit(u)) for u in ("https://w/a?pageId=42&x=/pages/7", "/spaces/S/pages/7/T", "/display/S/T")))
    assert tuple(got) == ("42", "7", None)


def test_page_url_and_base(spark):
    got = one(spark, fx.page_url(fx.base_url(F.lit("https://w//")), F.lit("S"), F.lit("7"), F.lit("A B&C")))
    assert got[0] == "https://w/spaces/S/pages/7/A+B&C"


def test_links(spark):
    rows = spark.createDataFrame([(" /pages/7\n",), ("https://w/x?pageId=9",), ("https://other/pages/1",), ("/about",), (None,)], "h string")
    kept = rows.select(fx.absolute_link(F.col("h"), BASE).alias("u")).where(fx.is_page_link(F.col("u"), BASE))
    assert tuples(kept) == [("https://w/pages/7",), ("https://w/x?pageId=9",)]


def test_uuid5_equals_the_standard_one(spark):
    ns = uuid.UUID(fx.CHUNK_NAMESPACE)
    names = [f"{i * 7919}_{i % 5}_{i % 3}" for i in range(200)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", fx.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(ns, r.n)) for r in got)
    assert one(spark, fx.chunk_id(F.lit("12"), F.lit(0), F.lit(1)))[0] == "2c28b616-5554-550c-8c55-749ffd70e52d"


def test_cache_key(spark):
    got = one(spark, fx.cache_key(F.lit("vpn"), F.lit(20), F.lit(False)))[0]
    assert got == hashlib.md5(b"vpn:20:False").hexdigest() == "6c4fd8835ad190b4bfe87d4e6646472a"


def test_has_table_and_linked_ids(spark):
    got = one(spark, *(fx.has_table(F.lit(t)) for t in ("A | B", "|---|", "a|b", "A |", None)))
    assert tuple(got) == (True, True, False, False, False)
    rows = spark.createDataFrame([([str(i) for i in range(12)],), (None,)], "l array<string>")
    assert [len(r[0]) for r in rows.select(fx.linked_ids(F.col("l"))).collect()] == [10, 0]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([1.0, 1.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in rows.select(fx.cosine(F.col("a"), F.col("b"))).collect()] == [0.8, 1.0, 0.0, 0.0]


def test_blocks_text(spark):
    schema = "b array<struct<type:string,text:string,rows:array<array<string>>>>"
    rows = spark.createDataFrame([([("header", "T", None), ("table", None, [["A", "B"], ["1", "2"]]), ("text", "end", None)],), ([],), (None,)], schema)
    assert [r[0] for r in rows.select(fx.blocks_text(F.col("b"))).collect()] == ["T\nA | B\n1 | 2\nend", "", ""]


def test_template_values_are_not_read_again(spark):
    got = one(spark, fx.fill_template("{context}|{question}", context=F.lit("c {question}"), question=F.lit("{context}")))[0]
    assert got == "c {question}|{context}"


def test_context_entry_writes_out_missing_parts(spark):
    null = F.lit(None).cast("string")
    assert one(spark, fx.context_entry(null, null, F.lit("x")))[0] == "Source: [None](None)\nx\n\n"


def test_or_default(spark):
    got = one(spark, *(fx.or_default(F.lit(x).cast("string"), F.lit("d")) for x in ("", None, "a")))
    assert tuple(got) == ("d", "d", "a")
