from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import tuples
from lodestack.operators.chunking import chunk_texts, hierarchical_chunks, split_by_separators
from lodestack.operators.html import html_blocks, html_links, parse_pages
from lodestack.plans import pipeline


def shape(html):
    return [(b["type"], b["text"] if b["type"] != "table" else b["rows"]) for b in html_blocks(html)]


def test_html_goldens():
    assert shape(None) == shape("") == []
    assert shape("<h2>Title</h2><p>a &amp; b</p>") == [("header", "Title"), ("text", "a & b")]
    assert shape("<p>a<br>b</p>") == [("text", "a b")]
    assert shape("<div><p>Hello <b>world</b></p></div>") == [("text", "Hello world")] * 2
    assert shape('<p>x</p><script>var t="</p>";</script><style>p{}</style>') == [("text", "x")]
    assert shape("<p>  </p>") == []
    assert shape("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>") == [("table", [["A", "B"], ["1", "2"]])]
    assert shape("<table><tbody><tr><td>1</td></tr></tbody></table>") == []
    assert shape("<table><tbody><tr><td><p>1</p></td></tr></tbody></table>") == [("text", "1")]
    assert shape("<table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>") == [("table", [["in"]])] * 2
    assert shape("<footer>f</footer><p>x</p>") == [("text", "x")]
    assert shape("<html><head><title>t</title></head><body><p>a<p>b<ul><li>c<li>d</ul></body></html>") == [("text", "a"), ("text", "b"), ("text", "c"), ("text", "d")]


def test_links_of_a_page(spark):
    assert html_links('<a href="/pages/7">a</a><a name="x">b</a><a href>c</a>') == ["/pages/7", ""]
    pages = spark.createDataFrame([("1", '<a href="/pages/7">a</a><a href="/pages/7">b</a><a href="/about">c</a>', "x"), ("2", None, "y")], "page_id string, content_html string, text string")
    got = {r.page_id: r for r in parse_pages(pages, base="https://w").collect()}
    assert got["1"].links == ["https://w/pages/7"] and got["2"].links == [] and got["2"].text == "" and got["2"].blocks == []


def test_chunk_goldens():
    assert list(hierarchical_chunks(None)) == list(hierarchical_chunks("")) == []
    assert list(hierarchical_chunks("Hello world.")) == [(0, 0, "Hello world.", "Hello world.")]
    assert [len(c[3]) for c in hierarchical_chunks("a" * 500)] == [500]
    got = list(hierarchical_chunks("word " * 90))
    assert [len(c[2]) for c in got] == [449, 449] and [(len(c[3]), len(c[3].split())) for c in got] == [(399, 80), (129, 26)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60))
def test_chunks_cover_the_text_and_keep_the_size(text, size):
    chunks = split_by_separators(text, size, size // 4)
    assert all(len(c) <= size or not any(s in c for s in ("\n", " ")) or " " not in c[1:] for c in chunks)
    joined = "".join(chunks)
    for letter in "ab":
        assert joined.count(letter) >= text.count(letter)


def test_chunks_of_odd_tables(spark):
    pages = spark.createDataFrame([("1", "a b"), ("1", "a b"), ("2", None), ("3", "  "), (None, "x")], "page_id string, content_text string").withColumn("chunk", F.lit("clash"))
    assert tuples(chunk_texts(pages), "page_id", "child_text") == [("1", "a b"), ("1", "a b"), (None, "x")]


def page(spark, page_id, version, text, synced="2024-01-01T00:00:00"):
    schema = "page_id string, version int, title string, url string, content_text string, internal_links array<string>, synced_at string"
    return spark.createDataFrame([(page_id, version, "T", "u", text, ["https://w/pages/9", "/x", None], synced)], schema)


def test_ingest_is_idempotent_and_replaces_pages(spark, tmp_path):
    path = str(tmp_path / "chunks")
    long = "\n\n".join(f"part {i} " + "word " * 70 for i in range(3))
    first = tuples(pipeline.ingest(page(spark, "7", 1, long), path), "id", "chunk")
    again = tuples(pipeline.ingest(page(spark, "7", 1, long), path), "id", "chunk")
    assert first == again and len(first) == 3
    assert len(tuples(pipeline.ingest(page(spark, "7", 2, "short"), path), "id")) == 1
    kept = str(tmp_path / "kept")
    pipeline.ingest(page(spark, "7", 1, long), kept)
    assert len(tuples(pipeline.ingest(page(spark, "7", 2, "short"), kept, replace_page=False), "id")) == 3


def test_chunks_carry_their_page(spark):
    row = pipeline.ingest(page(spark, "12", 1, "A | B")).first()
    assert (row.page_id, row.title, row.url, row.linked_page_ids, row.has_table) == ("12", "T", "u", ["9"], True)
    assert len(row.dense) == 384 and abs(sum(x * x for x in row.dense) - 1) < 1e-5


def test_pages_from_html(spark):
    raw = spark.createDataFrame([("1", "<h1>T</h1><p>x</p><a href='/pages/3'>l</a>")], "page_id string, content_html string")
    row = pipeline.pages_from_html(raw, "https://w").first()
    assert row.content_text == "T\nx" and row.internal_links == ["https://w/pages/3"]


def test_versions_of_a_page_keep_their_own_text(spark):
    rows = [("1", 1, "<p>old</p>"), ("1", 2, "<p>new</p>"), (None, 1, "<p>none</p>"), ("1", 2, "<p>new</p>")]
    got = pipeline.pages_from_html(spark.createDataFrame(rows, "page_id string, version int, content_html string"), "https://w")
    assert tuples(got, "page_id", "version", "content_text") == [("1", 1, "old"), ("1", 2, "new"), ("1", 2, "new"), (None, 1, "none")]
