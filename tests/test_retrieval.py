import numpy as np
from pyspark.sql import functions as F

from conftest import tuples
from lodestack.operators import answer, retrieval
from lodestack.plans import pipeline


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, id string, score double")


def two(spark):
    return hits(spark, [("q", i + 1, x, 1.0) for i, x in enumerate("ABC")]), hits(spark, [("q", i + 1, x, 1.0) for i, x in enumerate("CAD")])


def test_rank_fusion_goldens(spark):
    for k, base, want in ((2, 0, {"A": 0.833333, "C": 0.75, "B": 0.333333, "D": 0.25}), (60, 1, {"A": 0.032522, "C": 0.032266, "B": 0.016129, "D": 0.015873})):
        a, b = two(spark)
        got = {r.id: round(r.score, 6) for r in retrieval.rrf_fuse([a, b], k, base).collect()}
        assert got == want
        assert got == {r.id: round(r.score, 6) for r in retrieval.rrf_full_outer(a, b, k, base).collect()}
        assert tuples(retrieval.rrf_fuse([b, a], k, base)) == tuples(retrieval.rrf_fuse([a, b], k, base))
    a, b = two(spark)
    assert tuples(retrieval.in_both(a, b), "id") == [("A",), ("C",)]


def test_diversity_golden(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "id string, vec array<double>")
    v = spark.createDataFrame([("A", [0.8, 0.6]), ("B", [0.8, 0.6]), ("C", [0.6, -0.8]), ("D", None), ("E", [1.0])], "id string, vec array<double>")
    c = hits(spark, [("q", 1, "A", 3.0), ("q", 2, "B", 2.0), ("q", 3, "C", 1.0)])
    order = lambda lam, n=2: [r.id for r in retrieval.mmr(c, q, v, n, lam).orderBy("rank").collect()]
    assert order(0.7) == ["A", "C"] and order(1.0) == ["A", "B"] and order(0.7, 3) == ["A", "B", "C"]
    odd = hits(spark, [("q", 1, "D", 3.0), ("q", 2, "E", 2.0), ("q", 3, "A", 1.0)])
    assert [r.id for r in retrieval.mmr(odd, q, v, 1).collect()] == ["A"]


def test_dense_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)).round(1)
    x[5], x[6] = x[4], 0
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(4, [float(v) for v in x[4]]), (90, None), (91, [1.0]), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5).withColumn("rank", F.lit("clash"))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 8 * 8 * 3)  # several blocks of queries
    got = {}
    for r in retrieval.dense_topk(v.where("id % 10 = 0"), v, 7, 8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    n = np.linalg.norm(x, axis=1)
    s = np.round((x @ x.T) / np.where(n > 0, n, 1)[:, None] / np.where(n > 0, n, 1)[None, :], 9)
    for q in range(0, 60, 10):
        want = sorted(range(60), key=lambda j: (-s[q, j], j))[:7]
        assert [got[q][k] for k in range(1, 8)] == want
    assert retrieval.dense_topk(v.where("false"), v, 3, 8).count() == retrieval.dense_topk(v, v.where("false"), 3, 8).count() == 0


def test_copies_of_an_id_take_one_place(spark):
    rows = [(7, [1.0, 0.0])] * 9 + [(8, [0.9, 0.1]), (1, [0.8, 0.2]), (2, [0.7, 0.3]), (3, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>").coalesce(1)
    assert [r.id for r in retrieval.dense_topk(v.where("id = 7"), v, 4, 2).orderBy("rank").collect()] == [7, 8, 1, 2]
    assert [r.id for r in retrieval.dense_topk(v.where("id = 7"), v, 3, 2, exclude_self=True).orderBy("rank").collect()] == [8, 1, 2]
    apart = v.repartition(4)
    assert [r.id for r in retrieval.dense_topk(v.where("id = 7"), apart, 4, 2).orderBy("rank").collect()] == [7, 8, 1, 2]


def test_lsh_finds_most_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    rows = [(i, [float(v) for v in centres[i % 10] + 0.05 * rng.normal(size=16)]) for i in range(100)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    exact = {(r.query_id, r.id) for r in retrieval.dense_topk(v.where("id < 10"), v, 5, 16).collect()}
    near = {(r.query_id, r.id) for r in retrieval.dense_lsh_topk(v.where("id < 10"), v, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_sparse_side(spark):
    docs = spark.createDataFrame([(1, "Red apple apple"), (1, "Red apple apple"), (2, "green pear"), (3, None), (4, "")], "id long, text string")
    q = spark.createDataFrame([(7, "APPLE pear!"), (8, "nothing")], "id long, text string")
    got = [(r.query_id, r["rank"], r.id, round(r.score, 6)) for r in retrieval.bm25_topk(q, docs, "id", "text", "id", "text", 5).orderBy("rank").collect()]
    weights = {(r.id, r.term): r.weight for r in retrieval.bm25_weights(docs, "id", "text").collect()}
    want = sorted([(-round(weights[1, "apple"], 6), 1), (-round(weights[2, "pear"], 6), 2)])
    assert got == [(7, i + 1, d, -s) for i, (s, d) in enumerate(want)]
    assert retrieval.bm25_topk(q, docs.where("false"), "id", "text", "id", "text", 5).count() == 0


def test_sparse_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(i, sorted({int(t) for t in rng.integers(0, 12, 5)})) for i in range(80)]
    rows = [(i, t, [float(1 + (i * 7 + x) % 5) for x in t]) for i, t in docs] + [(3, docs[3][1], [float(1 + (21 + x) % 5) for x in docs[3][1]]), (90, None, None), (91, [], []), (None, [1], [1.0])]
    v = spark.createDataFrame(rows, "id long, terms array<int>, weights array<double>").repartition(3)
    asked = [(q, t, float(1 + t % 3)) for q in range(5) for t in ((0, q + 1, 11) if q < 4 else (99,))]
    monkeypatch.setattr(retrieval, "SCORE_BYTES", 8 * 5 * 7)
    for most in (32 * 2, 2**20):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", most)
        got = {}
        for r in retrieval.sparse_topk(spark.createDataFrame(asked, "query_id long, term int, qw double"), v, 6).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
        assert set(got) == {0, 1, 2, 3}
        for q in range(4):
            s = {i: sum(w * float(1 + (i * 7 + t) % 5) for p, t, w in asked if p == q and t in ts) for i, ts in docs}
            assert [got[q][k] for k in sorted(got[q])] == [(i, x) for i, x in sorted(s.items(), key=lambda y: (-y[1], y[0])) if x][:6]


def test_rerankers(spark):
    h = hits(spark, [("q", i, f"d{i}", 1.0 / i) for i in range(1, 8)])
    assert [r.id for r in retrieval.rerank_passthrough(h, 5).orderBy("rank").collect()] == [f"d{i}" for i in range(1, 6)]
    texts = spark.createDataFrame([("d1", "nothing"), ("d2", "the red door"), ("d3", None), ("d7", "red")], "id string, text string")
    q = spark.createDataFrame([("q", "red door")], "id string, text string")
    got = [(r.id, r.score) for r in retrieval.rerank_lexical(h, q, texts, 3).orderBy("rank").collect()]
    assert got == [("d2", 1.0), ("d7", 0.5), ("d1", 0.0)]
    assert retrieval.rerank_lexical(h.where("false"), q, texts).count() == 0
    by_length = [(r.id, r.score) for r in retrieval.rerank_by(h, q, texts, lambda qs, ts: [len(a) + len(b) for a, b in zip(qs, ts)], 2).orderBy("rank").collect()]
    assert by_length == [("d2", 20.0), ("d1", 15.0)]


def test_sources_context_history(spark):
    rows = [("q", 1, "T1", "u1", "a"), ("q", 2, "T2", "u2", "b"), ("q", 3, "T1b", "u1", "c"), ("q", 4, "X", None, "d"), ("q", 5, "Y", None, None)]
    h = spark.createDataFrame(rows, "query_id string, rank int, title string, url string, chunk string")
    assert [(r.source_no, r.title, r.url) for r in answer.sources_of(h).orderBy("source_no").collect()] == [(1, "T1", "u1"), (2, "T2", "u2"), (3, "X", None)]
    context = answer.context_of(h).first().context
    assert context.startswith("Source: [T1](u1)\na\n\nSource: [T2](u2)") and context.endswith("Source: [Y](None)\nNone\n\n")
    turns = spark.createDataFrame([("c", 1, "user", "hi"), ("c", 2, "assistant", "yo"), ("c", 3, "user", None)], "conv_id string, turn int, role string, content string")
    assert answer.history_of(turns.where("turn < 3")).first().history == "User: hi\nAssistant: yo"
    assert answer.history_of(turns, 1).first().history == "User: "
    assert answer.previous_turns(turns).count() == 2
    asked = spark.createDataFrame([("q", "{history}?"), ("z", "alone")], "query_id string, question string")
    got = {r.query_id: r.prompt for r in answer.prompts(asked, answer.context_of(h)).collect()}
    assert "{history}?" in got["q"] and "Sources:\n\n" in got["z"]


def test_session_counters(spark):
    turns = spark.createDataFrame([("c", 1, "user", "hi"), ("c", 2, "assistant", "yo"), ("c", 3, "user", None), ("d", 1, "assistant", "x"), ("d", 2, None, "y")], "conv_id string, turn int, role string, content string")
    assert tuples(answer.session_counters(turns)) == [("c", 2, 3), ("d", 0, 2)]


def test_event_stream(spark):
    rows = [("q", 0, '{"type":"sources","data":[]}'), ("q", 1, '{"type":"token","data":"a "}'), ("q", 2, "not json"), ("q", 3, '{"type":"token","data":"b"}'), ("q", 4, '{"type":"end"}'), ("q", 5, '{"type":"token","data":"c"}')]
    assert answer.fold_events(spark.createDataFrame(rows, "query_id string, seq int, event string")).first().answer == "a b"
    answers = spark.createDataFrame([("q", " two  words\n"), ("n", None)], "query_id string, answer string")
    sources = spark.createDataFrame([("q", 1, "T", "u")], "query_id string, source_no int, title string, url string")
    events = answer.answer_events(answers, sources)
    assert [r.event for r in events.where("query_id = 'n'").orderBy("seq").collect()] == ['{"type":"sources","data":[]}', '{"type":"end"}']
    assert answer.fold_events(events).first().answer == " two  words\n"


def test_whole_answer_pipeline(spark):
    schema = "page_id string, version int, title string, url string, content_text string, internal_links array<string>, synced_at string"
    pages = spark.createDataFrame([("1", 1, "Doors", "u1", "The red door is locked at night.", None, "x"), ("2", 1, "Fruit", "u2", "Apples are stored in the cellar.", None, "x")], schema)
    chunks = pipeline.ingest(pages)
    asked = spark.createDataFrame([("a", "Where are apples stored?"), ("b", "Where are apples stored?"), ("c", None)], "query_id string, question string")
    got = pipeline.answer_questions(asked, chunks)
    answers = {r.query_id: r.answer for r in got["answers"].collect()}
    assert set(answers) == {"a", "b"} and answers["a"] == answers["b"] and "cellar" in answers["a"] and "[Fruit](u2)" in answers["a"]
    nothing = pipeline.answer_questions(asked, chunks.where("false"))["answers"].collect()
    assert {r.answer for r in nothing} == {answer.NO_HITS}
    told = pipeline.answer_questions(asked, chunks, rerank=lambda qs, ts: [float("cellar" in x) for x in ts], generator=lambda ps: [f"{len(p)}!" for p in ps])["answers"].collect()
    assert len(told) == 2 and all(r.answer.endswith("!") for r in told)
    out = answer.generate(got["prompts"], lambda ps: [p[:3] for p in ps]).collect()
    assert len(out) == 2 and all(r.answer == "You" for r in out)


def test_top_k_is_pruned_before_the_shuffle(spark):
    h = hits(spark, [("q", 1, "a", 1.0)])
    plan = retrieval.top_per_query(h.drop("rank"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
