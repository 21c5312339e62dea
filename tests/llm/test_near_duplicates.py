import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from lodestack.llm import near_duplicates as nd


def corpus(n, seed=1, vocabulary=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"n{r.randrange(vocabulary)}"
            if r.random() < 0.3:
                w = w[: r.randint(len(w) // 2, len(w))]
        else:
            w = [f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(r.randint(3, 80))]
        out.append((f"p{i:03d}", " ".join(w)))
    return out


def brute(rows, width, s):
    sets = {}
    for k, t in rows:
        w = t.lower().split()
        x = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        if x:
            sets[k] = x
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) * s.denominator >= len(sets[a] | sets[b]) * s.numerator}


@pytest.mark.parametrize("width,s,seed", [(3, Fraction(1, 2), 1), (3, Fraction(1, 2), 2), (5, Fraction(4, 5), 3), (2, Fraction(1, 3), 4)])
def test_equals_brute_force(spark, width, s, seed):
    rows = corpus(220, seed)
    df = spark.createDataFrame(rows, "key string, body string").repartition(5)
    members, links = nd.near_duplicates(df, "key", None, "body", width, s)
    assert set(tuples(nd.pairs_of(members, links))) == brute(rows, width, s)


def test_every_length_of_prefix_is_complete(spark, monkeypatch):
    rows = corpus(150, 7)
    df = spark.createDataFrame(rows, "key string, body string")
    want = brute(rows, 3, Fraction(1, 2))
    for costs in ((1e9, 2e9, 3e9), (0.0, 0.0, 0.0)):
        monkeypatch.setattr(nd, "COSTS", costs)
        assert set(tuples(nd.pairs_of(*nd.near_duplicates(df, "key", None, "body", 3, Fraction(1, 2))))) == want


@pytest.mark.parametrize("cell_runs,tile_records", [(20, 10**9), (100, 100), (10, 10), (10**9, 10)])
def test_crowded_cells_and_hot_runs(spark, monkeypatch, cell_runs, tile_records):
    monkeypatch.setattr(nd, "CELL_RUNS", cell_runs)
    monkeypatch.setattr(nd, "TILE_RECORDS", tile_records)
    for s, costs in ((Fraction(1, 2), nd.COSTS), (Fraction(1, 3), (0.0, 0.0, 0.0)), (Fraction(1, 2), (0.0, 5.0, 50.0))):
        monkeypatch.setattr(nd, "COSTS", costs)
        rows = corpus(150, 9)
        df = spark.createDataFrame(rows, "key string, body string")
        assert set(tuples(nd.pairs_of(*nd.near_duplicates(df, "key", None, "body", 3, s)))) == brute(rows, 3, s)


def test_postings_of_a_record_do_not_grow_with_the_collection():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    sets = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([np.sort(r.integers(0, 2**62, 120)).tolist() for _ in range(200)])], names=["same", "runs"])

    class Sent:
        def __init__(self, splits):
            self.value = np.ones(1 << nd.SKETCH_BITS, np.int32), splits

    def written(splits):
        out = pa.Table.from_batches(nd._postings(Sent(splits), Fraction(1, 2), nd.COSTS, nd.TILE_RECORDS)([sets]))
        return sum(len(x) // 6 for x in out.column("data").to_pylist()), out.num_rows

    few, many, most = written({}), written({5: 64, 6: 64}), written({5: 2**20, 6: 2**20})
    assert few[1] <= 2 * nd.GROUPS * 200
    # at most once for each run of the prefix, however many cells there are
    assert many[1] <= most[1] <= few[0] and most[0] <= 8 * few[0]


@pytest.mark.parametrize("s,block_records", [(Fraction(1, 2), 10**9), (Fraction(1, 2), 40), (Fraction(1, 3), 40), (Fraction(4, 5), 40)])
def test_crowded_bands_by_bitmaps(spark, monkeypatch, s, block_records):
    monkeypatch.setattr(nd, "WORDS_A_MATCH", 10**12)  # every band in which runs meet
    monkeypatch.setattr(nd, "BLOCK_RECORDS", block_records)
    rows = corpus(150, 5)
    df = spark.createDataFrame(rows, "key string, body string").repartition(3)
    assert set(tuples(nd.pairs_of(*nd.near_duplicates(df, "key", None, "body", 3, s)))) == brute(rows, 3, s)


def test_only_bands_of_a_small_vocabulary_are_crowded(spark):
    import numpy as np

    r = np.random.default_rng(3)
    for most, crowded in ((600, {6: 1}), (2**60, {})):
        sets = spark.createDataFrame([(i, np.unique(r.integers(0, most, 100)).tolist()) for i in range(400)], "same long, runs array<long>")
        n = {b.band: b.n for b in sets.groupBy(F.floor(F.log2(F.size("runs"))).cast("int").alias("band")).agg(F.count("*").alias("n")).collect()}
        sent = spark.sparkContext.broadcast((nd.frequency_sketch(sets), {}))
        assert nd.crowded_bands(sets, sent, Fraction(1, 2), n) == crowded


def test_copies_of_a_third_and_groups(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(f"c{i:03d}", base) for i in range(90)] + [("d1", base + " eleven"), ("x", "quite another text with other words in it"), ("e", None), ("f", " "), ("g", "a b"), (None, base)]
    df = spark.createDataFrame(rows, "key string, text string").selectExpr("*", "1 AS same", "2 AS runs")
    members, links = nd.near_duplicates(df, "key", None, "text", 3, Fraction(1, 2))
    pairs = set(tuples(nd.pairs_of(members, links)))
    assert len(pairs) == 90 and ("c000", "d1") in pairs and ("c000", "c089") in pairs  # more copies than are written out: a star
    few = nd.pairs_of(members.where("key < 'c004' OR key > 'd'"), links)
    assert few.count() == 6 + 4
    groups = {r.key: (r.group_id, r.n_links) for r in nd.groups_of(members, links).collect()}
    assert groups["c050"] == ("c000", 1) and groups["d1"] == ("c000", 1) and groups["x"] == ("x", 0) and len(groups) == 92
    none = nd.near_duplicates(df.where("false"), "key", None, "text", 3, Fraction(1, 2))
    assert nd.pairs_of(*none).count() == nd.groups_of(*none).count() == 0


def test_pairs_of_different_texts_are_no_copies(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(f"c{i:03d}", base.replace(" ", "," * i + " ")) for i in range(70)] + [(f"e{i:03d}", base + "!") for i in range(66)] + [("d", base + " eleven")]
    df = spark.createDataFrame(rows, "key string, text string")
    members, links = nd.near_duplicates(df, "key", None, "text", 3, Fraction(1, 2))
    pairs = set(tuples(nd.pairs_of(members, links)))
    apart = [f"c{i:03d}" for i in range(70)] + ["d", "e000"]  # exact copies stand with their least key
    assert pairs == {(x, y) for x in apart for y in apart if x < y} | {("e000", f"e{i:03d}") for i in range(1, 66)}
    assert {r.group_id for r in nd.groups_of(members, links).collect()} == {"c000"}


def test_long_chains_become_one_group(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    members = spark.createDataFrame([(f"k{i:02d}", i) for i in range(41)], "key string, same long")
    assert {r.group_id for r in nd.groups_of(members, links).collect()} == {"k00"}


def test_chains_of_unfavourable_order_become_one_group(spark):
    chain = [0, *range(120, 0, -1)]
    links = spark.createDataFrame([(min(x, y), max(x, y)) for x, y in zip(chain, chain[1:])], "a long, b long")
    members = spark.createDataFrame([(f"k{i:03d}", i) for i in chain], "key string, same long")
    assert {r.group_id for r in nd.groups_of(members, links).collect()} == {"k000"}


def test_current_pages(spark):
    rows = [("1", 1, "a", "old"), ("1", 2, "b", "new"), ("1", 2, "b", "new"), ("2", None, None, None), (None, 1, "x", "x")]
    got = nd.current_pages(spark.createDataFrame(rows, "page_id string, version int, title string, content_text string"))
    assert tuples(got) == [("1", "b", "new"), ("2", None, None)]
