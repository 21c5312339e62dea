import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import tuples
from lodestack.llm import leakage, mixing, reading_level as rl
from lodestack.llm.queries import TOKENIZER
from lodestack.llm.words import words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=4), st.lists(st.sampled_from("abc"), max_size=40), st.integers(2, 5))
def test_search_equals_brute_force(items, text, run):
    found = leakage.WuManber(list(enumerate(items)), run).find(text)
    runs = {tuple(text[i : i + run]) for i in range(len(text) - run + 1)}
    assert found == {k for k, w in enumerate(items) if any(tuple(w[i : i + run]) in runs for i in range(len(w) - run + 1))}


def test_leaks_in_passes_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PATTERNS_PER_PASS", 3)  # several passes, items cut into stretches
    long = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"x {long.upper()}! y"), (1, f"x {long.upper()}! y"), (2, None), (3, ""), (4, long[:20]), (None, long), (5, "z " * 30000 + long)], "doc_id long, text string").selectExpr("*", "9 AS item_id")
    items = spark.createDataFrame([(10, long, "s"), (11, " ".join(long.split()[1:13]), "s"), (12, "short", None), (None, long, "s"), (13, None, "t")], "item_id long, item_text string, suite string")
    leaks = leakage.leaked_items(docs, items)
    assert tuples(leaks) == [(1, 10), (1, 11), (5, 10), (5, 11)]
    assert tuples(leakage.leak_report(leaks, items), "item_id", "n_docs") == [(10, 2), (11, 2), (12, 0), (13, 0)]
    assert leakage.leaked_items(docs, items.where("false")).count() == leakage.leaked_items(docs.where("false"), items).count() == 0


def test_isotonic_fit():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 2, 1, 1, 3])
    knots, values = rl.pool_adjacent_violators(x, y)
    assert np.allclose(np.interp(x, knots, values), [0, 4 / 3, 4 / 3, 4 / 3, 3]) and (np.diff(values) >= 0).all()


def test_surprisal_is_a_distribution():
    grams = rl.Trigrams([(0, words("a b c a b d")), (1, words("c d c d"))], 2)
    for ctx in ([1, 2], [3, 4], [0, 1]):
        p = [2 ** -grams.surprisal(np.array([*ctx, w]), (0, 1))[0, 0] for w in range(grams.size)]
        assert sum(p) <= 1 + 1e-9


def test_levels_of_the_samples_and_odd_rows(spark, data):
    samples = spark.read.parquet(f"{data}/level_samples.parquet")
    as_docs = samples.selectExpr("sample_id AS doc_id", "sample_text AS text", "' EN-gb' AS lang", "reading_level AS truth")
    got = {r.doc_id: r.reading_level for r in rl.reading_levels(as_docs, samples).collect()}
    truth = {r.doc_id: r.truth for r in as_docs.collect()}
    assert got == truth
    held = rl.reading_levels(as_docs.where("doc_id % 2 = 0"), samples.where("sample_id % 2 = 1"))
    assert np.mean([truth[r.doc_id] == r.reading_level for r in held.collect()]) > 0.9
    odd = spark.createDataFrame([(1, None, "en"), (2, "too short", "en"), (3, "word " * 70, "de"), (None, "word " * 70, "en"), (4, "the map " * 5000, "en"), (4, "the map " * 5000, "en"), (5, "x " * 70, None)], "doc_id long, text string, lang string")
    assert tuples(rl.reading_levels(odd, samples), "doc_id") == [(4,)]
    assert rl.level_profile(rl.reading_levels(odd.where("false"), samples)).count() == 0
    with pytest.raises(ValueError):
        rl.reading_levels(odd, samples.where("false"))


def test_pouring():
    assert mixing.pour(10, [1, 1], [100, 100]) == [5, 5]
    assert mixing.pour(10, [1, 1, 2], [1, 100, 100]) == pytest.approx([1, 3, 6])
    assert mixing.pour(10, [1, 1], [2, 3]) == [2, 3] and mixing.pour(0, [1], [1]) == [0.0]


def test_siblings_before_ancestors():
    w = {("a", "en", "x"): 0.25, ("a", "en", "y"): 0.25, ("b", "en", "z"): 0.5}
    got = mixing.budgets(w, {("a", "en", "x"): 10.0, ("a", "en", "y"): 100.0, ("b", "en", "z"): 100.0}, 100)
    assert got == pytest.approx({("a", "en", "x"): 10, ("a", "en", "y"): 40, ("b", "en", "z"): 50})


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_mix_shares_repeats_and_odd_rows(spark):
    rows = [(i, "one two three four", "Big_Wiki" if i % 3 else "big-wiki ", "en") for i in range(600)] + [(i, "one two three four", "small-notes", ["EN", "de_DE", None][i % 3]) for i in range(1000, 1060)]
    rows += [(1, "one two three four", "Big_Wiki", "en"), (None, "x", "big-wiki", "en"), (7000, None, "big-wiki", "en"), (7001, "", "big-wiki", "en"), (7002, "x", None, "en"), (7003, "x", "other", "en")]
    targets = spark.createDataFrame([("big-wiki", 0.7, 1), ("small_notes", 0.3, 3), ("gone-faq", 0.1, None), (None, 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs_of(spark, rows).selectExpr("*", "1 AS n_tokens"), targets, TOKENIZER)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big-wiki", "small-notes", "gone-faq"} and got["gone-faq"].n_docs == 0
    assert abs(got["big-wiki"].actual_share - 0.7) < 0.02 and abs(got["small-notes"].actual_share - 0.3) < 0.02
    used = mix.groupBy("source", "doc_id").count().groupBy("source").agg({"count": "max"})
    assert {r[0]: r[1] for r in used.collect()} == {"big-wiki": 1, "small-notes": 3}
    assert mix.count() == mix.distinct().count()
    again = mixing.mix_sources(docs_of(spark, rows), targets, TOKENIZER)[0]
    assert tuples(again) == tuples(mix)
    assert mixing.mix_sources(docs_of(spark, rows), targets, TOKENIZER, seed=8)[0].count() > 0


def test_fixed_total_and_empty_tables(spark):
    docs = docs_of(spark, [(i, "one two three four", "a-wiki", "en") for i in range(100)] + [(500, "one two three four", "b-wiki", "en")])
    targets = spark.createDataFrame([("a-wiki", 0.5, 1), ("b-wiki", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: (r.n_tokens, r.max_uses) for r in mixing.mix_sources(docs, targets, TOKENIZER, total_tokens=100)[1].collect()}
    assert got == {"a-wiki": (92, 1), "b-wiki": (8, 2)}  # the shortage goes to the sibling
    for d, t in ((docs.where("false"), targets), (docs, targets.where("false"))):
        mix, report = mixing.mix_sources(d, t, TOKENIZER)
        assert mix.count() == 0 and sum(r.n_tokens for r in report.collect()) == 0


def test_search_tables_are_bounded(spark):
    import pickle

    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, "a b c")], "item_id long, item_text string")
    packed = list(leakage.search_tables(items, 12, 10**6, 4_000))
    assert len(packed) > 4 and all(len(p) <= 4_000 for p in packed)
    patterns = {p for x in packed for b in pickle.loads(x).buckets.values() for p in b}
    assert len(patterns) == 289


def test_shortages_go_to_siblings_before_ancestors():
    w = {("d", "en", "a"): 0.3, ("d", "en", "b"): 0.2, ("e", "en", "c"): 0.5}
    got = mixing.budgets(w, {("d", "en", "a"): 10.0, ("d", "en", "b"): 100.0, ("e", "en", "c"): 100.0}, 100.0)
    assert got == {("d", "en", "a"): 10.0, ("d", "en", "b"): 40.0, ("e", "en", "c"): 50.0}
    got = mixing.budgets(w, {("d", "en", "a"): 10.0, ("d", "en", "b"): 20.0, ("e", "en", "c"): 100.0}, 100.0)
    assert got == {("d", "en", "a"): 10.0, ("d", "en", "b"): 20.0, ("e", "en", "c"): 70.0}
