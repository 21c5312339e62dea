import numpy as np

from conftest import tuples
from lodestack.llm import knn

KIND = "id string, dense array<float>"


def frame(spark, x, names=None):
    return spark.createDataFrame([(names[i] if names else f"v{i:05d}", [float(t) for t in x[i]]) for i in range(len(x))], KIND)


def clusters(n, dim=16, size=8, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n // size, dim))
    return np.repeat(c, size, axis=0) + 0.25 * rng.normal(size=(n // size * size, dim))


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k]


def test_recall_over_many_parts(spark):
    x = clusters(2400).astype(np.float32)
    got = knn.nearest_vectors(frame(spark, x).repartition(4), dim=16, k=5, part_rows=200, max_sample=1200).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.id, set()).add(r.neighbour_id)
    want = exact(x, 5)
    hit = sum(f"v{j:05d}" in mine.get(f"v{i:05d}", ()) for i in range(len(x)) for j in want[i])
    assert hit / want.size >= 0.9 and all(len(v) == 5 for v in mine.values())


def test_tree_of_routers(spark, monkeypatch):
    x = clusters(2400).astype(np.float32)
    want = exact(x, 5)
    for branch, room in ((4, knn.ROUTER_BYTES), (4, 0), (2, knn.ROUTER_BYTES), (2, 0)):
        monkeypatch.setattr(knn, "MAX_BRANCH", branch)
        monkeypatch.setattr(knn, "ROUTER_BYTES", room)
        monkeypatch.setattr(knn, "ROUTED_ROWS", 300)
        mine = {}
        for r in knn.nearest_vectors(frame(spark, x).repartition(4), dim=16, k=5, part_rows=200, max_sample=600).collect():
            mine.setdefault(r.id, set()).add(r.neighbour_id)
        hit = sum(f"v{j:05d}" in mine.get(f"v{i:05d}", ()) for i in range(len(x)) for j in want[i])
        assert len(mine) == len(x) and hit / want.size >= 0.85, (branch, room, hit / want.size)


def test_a_tree_keeps_neighbours_together():
    rng = np.random.default_rng(4)

    def group_members(groups):
        c = np.repeat(rng.normal(size=(groups, 64)), 2, axis=0)
        return knn.unit_rows((c + 0.45 * rng.normal(size=c.shape)).astype(np.float32))

    tree = knn.Tree(24)
    fit = group_members(3000)
    root = knn.fit_router(fit, 10)
    first = root.probabilities(fit).argmax(axis=1)
    tree.levels.append({0: root})
    last = {n: knn.fit_router(fit[first == n], 10) for n in range(len(root.b))}
    x = group_members(500)  # not among those fitted
    least, most = knn.probes_of(2, knn.MAX_PROBES)
    at, leaf, _ = knn.most_probable(*tree.below(last, x, *tree.down(x, knn.NODE_BEAM), most), least, most, knn.COVER)
    seen = [set() for _ in x]
    for i, part in zip(at.tolist(), leaf.tolist()):
        seen[i].add(part)
    assert max(map(len, seen)) <= most and len({p for v in seen for p in v}) > 80
    assert np.mean([bool(seen[i] & seen[i + 1]) for i in range(0, len(x), 2)]) >= 0.95


def test_parts_grow_with_the_collection_and_are_balanced():
    for n in (10**5, 4 * 10**7, 10**11):
        levels, branch = knn.shape_of(n, 5_000)
        assert branch <= knn.MAX_BRANCH and n / 5_000 <= branch**levels * 1.01
    x = knn.unit_rows(clusters(6000).astype(np.float32))
    x[:2000] = knn.unit_rows(x[:1] + 0.3 * np.random.default_rng(0).normal(size=(2000, 16)).astype(np.float32))  # a third in one place
    top, _ = knn.best_parts(knn.fit_router(x, 40).probabilities(x), knn.MIN_PROBES)
    load = np.bincount(top.ravel(), minlength=40)
    assert load.max() <= 2 * load.mean()


def test_one_part_is_exact_and_ranked(spark):
    x = clusters(160).astype(np.float32)
    got = {}
    for r in knn.nearest_vectors(frame(spark, x), dim=16).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbour_id
    for i, row in enumerate(exact(x, 5)):
        assert set(got[f"v{i:05d}"].values()) == {f"v{j:05d}" for j in row}


def test_copies_of_a_third_of_all_rows(spark):
    x = clusters(600).astype(np.float32)
    x[:200] = x[0]
    got = {}
    for r in knn.nearest_vectors(frame(spark, x).repartition(6), dim=16, part_rows=100, max_sample=300).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour_id, r.cosine))
    assert [n for _, n, _ in sorted(got["v00150"])] == [f"v{i:05d}" for i in range(5)] and all(abs(c - 1) < 1e-6 for *_, c in got["v00150"])
    assert [n for _, n, _ in sorted(got["v00002"])] == ["v00000", "v00001", "v00003", "v00004", "v00005"]


def test_blocks_of_large_parts(spark, monkeypatch):
    x = clusters(400).astype(np.float32)
    plain = tuples(knn.nearest_vectors(frame(spark, x), dim=16, part_rows=200), "id", "neighbour_id")
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    assert tuples(knn.nearest_vectors(frame(spark, x), dim=16, part_rows=200), "id", "neighbour_id") == plain


def test_unusable_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", None), ("d", [1.0]), ("e", [0.0, 0.0]), ("f", [float("nan"), 1.0]), (None, [1.0, 1.0]), ("g", [0.0, -2.0]), ("h", [1.0, None])]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS same", "2 AS part")
    assert tuples(knn.neighbour_pairs(knn.nearest_vectors(df, dim=2))) == [("a", "b"), ("a", "g"), ("b", "g")]
    assert knn.nearest_vectors(df.where("id = 'a'"), dim=2).count() == 0
    assert knn.nearest_vectors(df.where("false"), dim=2).count() == 0
