import re

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import tuples
from lodestack.llm import split


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.#-\n  　é", max_size=300), st.integers(5, 40), st.integers(0, 12))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = split.split_text(text, limit, overlap)
    covered = set()
    for i, (s, e, cut) in enumerate(pieces):
        assert 0 < e - s <= limit and not text[s].isspace() and not text[e - 1].isspace()
        if i:
            assert pieces[i - 1][0] < s <= e and pieces[i - 1][1] - s <= overlap
        covered |= set(range(s, e))
    assert all(i in covered or c.isspace() for i, c in enumerate(text))
    if len(text.strip()) > limit:
        assert any(c == "forced" for *_, c in pieces) == bool(re.search(r"\S{%d}" % (limit + 1), text))
        assert pieces[-1][2] == "end"


def test_cuts_follow_the_structure():
    text = "# One\n" + "a " * 30 + "\n\n# Two\n" + "b " * 30 + "\n\n## Inner\n" + "c " * 30
    got = [text[s:e] for s, e, _ in split.split_text(text, 100, 0)]
    assert [g.split("\n")[0] for g in got] == ["# One", "# Two", "## Inner"]
    two = [text[s:e] for s, e, _ in split.split_text(text, 160, 0)]
    assert two[1].startswith("# Two") and "## Inner" in two[1]


def test_overlap_and_forced_cuts():
    words = "word " * 100
    got = split.split_text(words, 100, 20)
    assert all(15 <= a[1] - b[0] <= 20 for a, b in zip(got, got[1:]))
    run = split.split_text("x" * 250, 100, 20)
    assert [(s, e) for s, e, _ in run] == [(0, 80), (60, 160), (140, 240), (220, 250)] and {c for *_, c in run[:-1]} == {"forced"}


def test_odd_items(spark):
    rows = [("k", "1", None, 5, 1), ("k", "2", "", 5, 1), ("k", "3", "  abc     ", 5, 1), ("k", "4", "ab cd ef", 5, 1), ("k", "4", "ab cd ef", 5, 1), ("k", "5", "x" * 20000, 5, 1), ("k", None, "aa bb cc", 5, 1)]
    items = spark.createDataFrame(rows, "item_kind string, item_key string, text string, size_limit int, overlap int").selectExpr("*", "1 AS piece", "2 AS cut")
    pieces = split.split_items(items)
    assert tuples(split.oversized_items(pieces)) == [("k", "4", "natural"), ("k", "5", "forced"), ("k", None, "natural")]
    assert split.split_items(items.where("false")).count() == 0


def test_brute_force_on_the_tables(spark, data):
    pages, chunks = spark.read.parquet(f"{data}/pages.parquet"), spark.read.parquet(f"{data}/chunks.parquet")
    want = set()
    for kind, key, text, limit in [("page", f"{r.page_id}:{r.version}", r.content_text, 1400) for r in pages.collect()] + [x for r in chunks.collect() for x in (("parent", f"{r.page_id}:{r.parent_index}", r.parent_text, 1400), ("chunk", r.id, r.chunk, 400))]:
        if text and len(text.strip()) > limit:
            want.add((kind, key, "forced" if any(len(w) > limit for w in text.split()) else "natural"))
    assert set(tuples(split.oversized_items(split.split_items(split.wiki_items(pages, chunks))))) == want
