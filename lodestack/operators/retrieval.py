"""Hybrid retrieval for batches of queries: dense and sparse top-k, rank fusion, diversity, reranking.

Hits are ``query_id, rank, id, score``. Ties are always broken by id. Scores are rounded to ``SCORE_DIGITS`` before
they are ranked, so that the order does not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import terms
from lodestack.runtime import BROADCAST_BYTES, cut_lineage, pick_rows

SCORE_DIGITS = 9
K1, B = 1.2, 0.75
#: Fixed values of rank fusion: constant and first rank, as a vector server documents them.
RRF_K, RRF_BASE = 2, 0


def top_per_query(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best ids of each query with their rank from 1; a group limit prunes before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _terms_of(docs: DataFrame, id_col: str, text: str, ids_unique: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    if not ids_unique:
        rows = rows.dropDuplicates(["id"])
    return rows.select("id", terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)


def postings(docs: DataFrame, id_col: str, text: str, ids_unique: bool = False) -> DataFrame:
    """``id, term, tf``; null texts give none; repeated rows of an id count once.

    ``ids_unique`` says that no id is repeated, which spares a shuffle of the texts.
    """
    return _terms_of(docs, id_col, text, ids_unique).select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25_weights(docs: DataFrame, id_col: str, text: str, ids_unique: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """``id, term, weight`` of every posting: BM25 with non-negative idf.

    A document's length rides along its terms, and the corpus totals come from the documents, so only the postings
    and the document frequencies are shuffled, once each.
    """
    rows = _terms_of(docs, id_col, text, ids_unique).withColumn("len", F.size("terms"))
    one = rows.agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    posted = rows.select("id", "len", F.explode("terms").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    every = df.crossJoin(F.broadcast(one))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    every = every.select("term", idf.alias("idf"), (F.col("total") / F.col("n")).alias("avg_len"))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return posted.join(every, "term").select("id", "term", (F.col("idf") * tf).alias("weight"))


#: Bytes of scores that a task holds at a time: queries times rows.
SCORE_BYTES = 32 * 1024 * 1024


class _Best:
    """The ``k`` best ids of every query that a task has seen; an id counts once, with its best score; ties by id."""

    def __init__(self, k: int):
        self.k, self.size, self.limit = k, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None) -> None:
        """``scores``: queries times rows of distinct ids, -inf for no hit; ``at``: numbers of the queries."""
        n_q, n = scores.shape
        m = min(n, self.k)
        # everything at or above the k-th best, so that ties are left to the ids
        least = np.partition(scores, n - m, axis=1)[:, n - m : n - m + 1]
        q, d = np.nonzero((scores >= least) & (scores > -np.inf))
        self.parts.append((q if at is None else at[q], ids[d], scores[q, d]))
        self.size += len(q)
        if self.size > max(self.limit, 4 * self.k * n_q):
            self.prune()
            self.limit = 2 * self.size

    def prune(self) -> None:
        q, ids, s = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((-s, ids, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.empty(0, bool)
        q, ids, s = q[first], ids[first], s[first]
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        starts = np.searchsorted(q, q)
        keep = np.arange(len(q)) - starts < self.k
        self.parts, self.size = [(q[keep], ids[keep], s[keep])], int(keep.sum())

    def batch(self, query_ids: np.ndarray, q_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        self.prune()
        q, ids, s = self.parts[0]
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q].tolist(), q_type), pa.array(ids.tolist(), id_type), pa.array(s, pa.float64())], names=["query_id", "id", "score"])


def _collapsed(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of equal ids as one column of their greatest score."""
    own, of = np.unique(ids, return_inverse=True)
    if len(own) == len(ids):
        return scores, ids
    order = np.argsort(of, kind="stable")
    return np.maximum.reduceat(scores[:, order], np.searchsorted(of[order], np.arange(len(own))), axis=1), own


def _blocks_of_terms(query_terms: DataFrame) -> Iterator[tuple[list, dict]]:
    """Query ids, the queries of each term and their weights, in blocks of a bounded size."""
    ids: list = []
    place: dict = {}
    by_term: dict = {}
    size = 0
    for q, term, w in query_terms.select("query_id", "term", F.col("qw").cast("double")).sort("query_id").toLocalIterator():
        if q not in place:
            if size > BROADCAST_BYTES // 32:
                yield ids, by_term
                ids, place, by_term, size = [], {}, {}, 0
            place[q] = len(ids)
            ids.append(q)
        at, ws = by_term.setdefault(term, ([], []))
        at.append(place[q])
        ws.append(w)
        size += 1
    if ids:
        yield ids, by_term


def sparse_topk(query_terms: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Sum over shared terms of query weight times the term's weight; ids that share no term are no hits.

    ``query_terms``: ``query_id, term, qw``; ``vectors``: ``id, terms, weights`` (two arrays of one length), one row per
    id; repeated rows of an id count once, with the best score. The query set is stated by the caller; its terms are
    sent in blocks of a bounded size, each scanned against all vectors, of which every task keeps its ``k`` best per
    query. So neither postings nor pairs of a query and a document are shuffled, and a term that all documents hold
    costs one pass over them.
    """
    spark = vectors.sparkSession
    id_type, q_type = vectors.schema["id"].dataType.simpleString(), query_terms.schema["query_id"].dataType.simpleString()
    base = vectors.select("id", "terms", F.col("weights").cast("array<double>").alias("weights")).where(F.col("id").isNotNull() & (F.size("terms") > 0))
    out = None
    for ids, by_term in _blocks_of_terms(query_terms):
        sent = spark.sparkContext.broadcast((ids, {t: (np.array(a), np.array(w)) for t, (a, w) in by_term.items()}))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, by_term = sent.value
            query_ids, best, kinds = np.array(ids, dtype=object), _Best(k), None
            step = max(1, SCORE_BYTES // (8 * len(ids)))
            qkind = pa.array(ids[:1]).type
            for whole in batches:
                for a in range(0, whole.num_rows, step):
                    batch = whole.slice(a, step)
                    kinds = batch.column(0).type
                    lengths = batch.column(1).value_lengths().to_numpy()
                    doc = np.repeat(np.arange(batch.num_rows), lengths)
                    terms_, weights = batch.column(1).flatten(), batch.column(2).flatten().to_numpy(zero_copy_only=False)
                    coded = terms_.dictionary_encode()
                    code = coded.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(code, kind="stable")
                    ends = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
                    scores = np.zeros((len(ids), batch.num_rows))
                    shared = np.zeros(scores.shape, bool)
                    for c, term in enumerate(coded.dictionary.to_pylist()):
                        asked = by_term.get(term)
                        if asked is None:
                            continue
                        at = order[ends[c] : ends[c + 1]]
                        w = weights[at]
                        at, w = at[w != 0], w[w != 0]  # a vector may name a term once only
                        cell = np.ix_(asked[0], doc[at])
                        scores[cell] += asked[1][:, None] * w[None, :]
                        shared[cell] = True
                    scores = np.where(shared, np.round(scores, SCORE_DIGITS), -np.inf)
                    best.add(*_collapsed(scores, np.array(batch.column(0).to_pylist())))
            got = best.batch(query_ids, qkind, kinds) if kinds is not None else None
            if got is not None:
                yield got

        part = base.mapInArrow(scan, f"query_id {q_type}, id {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {q_type}, rank int, id {id_type}, score double")
    once = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_per_query(once, k).select("query_id", "rank", "id", "score")


def bm25_topk(queries: DataFrame, docs: DataFrame, id_col: str, text: str, q_id: str, q_text: str, k: int, ids_unique: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 top-k of every query: one pass over the documents for lengths and the frequencies of the queries' terms, one for the scores.

    The inverse document frequency rides on the query's weights, the rest of the weight on the document's terms.
    """
    asked = query_terms(queries, q_id, q_text)
    rows = _terms_of(docs, id_col, text, ids_unique)
    one = rows.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total")).first()
    if not one.n:
        return sparse_topk(asked, rows.select("id", "terms", F.array().cast("array<double>").alias("weights")), k)
    wanted = asked.select("term").distinct()
    df = rows.select(F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(one.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, "term").select("query_id", "term", (F.col("qw") * idf).alias("qw"))
    return sparse_topk(weighted, _saturated(rows, one.total / one.n, k1, b), k)


def _saturated(rows: DataFrame, avg_len: float, k1: float, b: float) -> DataFrame:
    """``id, terms, weights``: every document's distinct terms with their frequencies' share of the BM25 weight."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            coded = batch.column(1).flatten().dictionary_encode()
            many = max(1, len(coded.dictionary))
            pair, tf = np.unique(doc * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            of = pair // many
            w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[of] / avg_len))
            ends = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
            found = coded.dictionary.take(pa.array(pair % many))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(w))], names=["id", "terms", "weights"])

    return rows.mapInArrow(run, f"id {id_type}, terms array<string>, weights array<double>")


def query_terms(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """``query_id, term, qw``: how often a query holds a term."""
    return postings(queries, id_col, text).select(F.col("id").alias("query_id"), "term", F.col("tf").cast("double").alias("qw"))


def _blocks_of_queries(queries: DataFrame, dim: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit rows of the queries, in blocks of a bounded size."""
    most = max(1, BROADCAST_BYTES // (8 * max(1, dim)))
    ids, rows = [], []

    def block():
        x = np.array(rows, dtype=np.float64)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return list(ids), x / np.where(n > 0, n, 1)

    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == most:
            yield block()
            ids, rows = [], []
    if ids:
        yield block()


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, dim: int, exclude_self: bool = False) -> DataFrame:
    """Exact cosine top-k of every query among all vectors; a zero vector has cosine 0 with any other.

    Both inputs: ``id, vec``; vectors of another length and null ids are left out. A repeated id counts once, with its
    best score, and takes one of the ``k`` places.
    The query set is stated by the caller; it passes through the driver and is sent in blocks of a bounded size, each
    scanned against all vectors, of which every task keeps its ``k`` best per query before the final ranking. A task
    holds ``SCORE_BYTES`` of scores at a time.
    """
    usable = lambda df: df.select("id", F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull()))
    spark = vectors.sparkSession
    id_type = vectors.schema["id"].dataType.simpleString()
    q_type = queries.schema["id"].dataType.simpleString()
    base = usable(vectors)
    out = None
    for ids, x in _blocks_of_queries(usable(queries).dropDuplicates(["id"]), dim):
        sent = spark.sparkContext.broadcast((ids, x))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, x = sent.value
            query_ids, best, kind = np.array(ids, dtype=object), _Best(k), None
            step = max(1, SCORE_BYTES // (8 * len(ids)))
            own_ids = np.array(ids)
            for whole in batches:
                for a in range(0, whole.num_rows, step):
                    batch = whole.slice(a, step)
                    kind = batch.column(0).type
                    own = np.array(batch.column(0).to_pylist())
                    v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                    n = np.linalg.norm(v, axis=1)
                    s = np.round((x @ v.T) / np.where(n > 0, n, 1)[None, :], SCORE_DIGITS)
                    s[np.isnan(s)] = -np.inf
                    if exclude_self:
                        s[own_ids[:, None] == own[None, :]] = -np.inf
                    best.add(*_collapsed(s, own))
            got = best.batch(query_ids, pa.array(ids[:1]).type, kind) if kind is not None else None
            if got is not None:
                yield got

        part = base.mapInArrow(scan, f"query_id {q_type}, id {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {q_type}, rank int, id {id_type}, score double")
    once = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_per_query(once, k).select("query_id", "rank", "id", "score")


def dense_lsh_topk(queries: DataFrame, vectors: DataFrame, k: int, bucket_length: float = 1.0, tables: int = 6) -> DataFrame:
    """Approximate dense top-k by random projections over unit vectors; for collections too large for exact scans."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    unit = Normalizer(inputCol="raw", outputCol="unit")
    q = unit.transform(queries.select(F.col("id").alias("query_id"), array_to_vector("vec").alias("raw"))).select("query_id", "unit")
    v = unit.transform(vectors.select("id", array_to_vector("vec").alias("raw"))).select("id", "unit")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=7).fit(v)
    near = model.approxSimilarityJoin(q, v, 2.0, distCol="far")
    scored = near.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.id").alias("id"), F.round(1 - F.col("far") * F.col("far") / 2, SCORE_DIGITS).alias("score"))
    return top_per_query(scored.dropDuplicates(["query_id", "id"]), k).select("query_id", "rank", "id", "score")


def rrf_fuse(lists: list[DataFrame], k: int = RRF_K, base: int = RRF_BASE, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``1 / (k + rank)`` over the lists that hold an id, ranks from ``base``."""
    both = None
    for one in lists:
        part = one.select("query_id", "id", (F.lit(1.0) / (F.lit(float(k)) + F.col("rank") - 1 + base)).alias("part"))
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    ranked = top_per_query(fused, limit if limit is not None else 2**31 - 1)
    return ranked.select("query_id", "rank", "id", "score")


def rrf_full_outer(a: DataFrame, b: DataFrame, k: int = RRF_K, base: int = RRF_BASE) -> DataFrame:
    """The same fusion of two lists as a full outer join; an id missing in one adds nothing there."""
    part = lambda df, name: df.select("query_id", "id", (F.lit(1.0) / (F.lit(float(k)) + F.col("rank") - 1 + base)).alias(name))
    both = part(a, "x").join(part(b, "y"), ["query_id", "id"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return top_per_query(both.select("query_id", "id", F.round(zero("x") + zero("y"), SCORE_DIGITS).alias("score")), 2**31 - 1).select("query_id", "rank", "id", "score")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates that both lists hold."""
    return a.select("query_id", "id").intersect(b.select("query_id", "id"))


def mmr(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, limit: int, lam: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: greedily ``lam * relevance - (1 - lam) * highest similarity to the chosen ones``.

    ``candidates``: hits, a bounded list per query; ``queries`` and ``vectors``: ``id, vec``; a null vector or one of
    another length than the query's counts as all zero. Queries of at most ``limit`` candidates keep their order. The result keeps the candidates' scores, in order of selection.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("qvec")).dropDuplicates(["query_id"])
    candidates = cut_lineage(candidates)  # they pick the vectors and are joined with them
    v = pick_rows(vectors, candidates, "vec").select("id", F.col("vec").cast("array<double>").alias("vec"))
    rows = candidates.select("query_id", "id", "rank", "score").join(v, "id").join(q, "query_id")
    types = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank"]).reset_index(drop=True)
        if len(pdf) > limit:
            y = np.nan_to_num(np.array(pdf["qvec"][0] if pdf["qvec"][0] is not None else [], dtype=float))
            fits = lambda v: v is not None and len(v) == len(y)
            x = np.nan_to_num(np.array([v if fits(v) else np.zeros(len(y)) for v in pdf["vec"]], dtype=float).reshape(len(pdf), len(y)))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            rel = x @ (y / max(np.linalg.norm(y), 1e-300))
            near, left, chosen = np.zeros(len(x)), list(range(len(x))), []
            while left and len(chosen) < limit:
                worth = np.round(lam * rel[left] - (1 - lam) * near[left], SCORE_DIGITS)
                best = left.pop(int(np.argmax(worth)))  # the earliest of equal ones
                chosen.append(best)
                near = np.maximum(near, x @ x[best])
            pdf = pdf.iloc[chosen]
        return pd.DataFrame({"query_id": pdf["query_id"], "rank": np.arange(1, len(pdf) + 1, dtype=np.int32), "id": pdf["id"], "score": pdf["score"]})

    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {types['query_id']}, rank int, id {types['id']}, score double")


def rerank_passthrough(hits: DataFrame, top_n: int = 5) -> DataFrame:
    """Without a model: the first ``top_n`` of each query with their scores."""
    return hits.where(F.col("rank") <= top_n).select("query_id", "rank", "id", "score")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that a text holds; 0 for a query without terms."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(q, terms(text))) / F.size(q), SCORE_DIGITS))


def rerank_lexical(hits: DataFrame, queries: DataFrame, texts: DataFrame, top_n: int = 5) -> DataFrame:
    """Hits scored anew by lexical overlap with their query; ``queries`` and ``texts``: ``id, text``. Only the texts of hits are moved."""
    pairs = _pairs(hits, queries, texts)
    return top_per_query(pairs.select("query_id", "id", lexical_overlap(F.col("question"), F.col("text")).alias("score")), top_n).select("query_id", "rank", "id", "score")


def rerank_by(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], top_n: int = 5) -> DataFrame:
    """Hits scored anew by a model: a callable from questions and texts, pair by pair, to scores, called batch by batch in the workers.

    A null question or text is handed over as the empty text.
    """
    pairs = _pairs(hits, queries, texts)
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                scores = scorer([x or "" for x in pdf["question"]], [x or "" for x in pdf["text"]])
                yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "score": np.round(np.asarray(list(scores), dtype=float), SCORE_DIGITS)})

    scored = pairs.select("query_id", "id", "question", "text").mapInPandas(run, f"query_id {types['query_id']}, id {types['id']}, score double")
    return top_per_query(scored, top_n).select("query_id", "rank", "id", "score")


def _pairs(hits: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    hits = cut_lineage(hits.select("query_id", "id"))
    q = queries.select(F.col("id").alias("query_id"), F.col("text").alias("question"))
    return hits.join(pick_rows(texts, hits, "text"), "id").join(q, "query_id")


def distinct_queries(queries: DataFrame, text: str, limit: int = 20, use_mmr: bool = False) -> DataFrame:
    """``cache_key, text``: each different query once, which is what a result cache would compute."""
    from lodestack.functions.text import cache_key

    keyed = queries.where(F.col(text).isNotNull()).select(cache_key(F.col(text), F.lit(limit), F.lit(use_mmr)).alias("cache_key"), F.col(text).alias("text"))
    return keyed.groupBy("cache_key").agg(F.min("text").alias("text"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, limit: int = 20, use_mmr: bool = False, dim: int = 384, rrf_k: int = RRF_K, rrf_base: int = RRF_BASE, lam: float = 0.7, ids_unique: bool = False) -> DataFrame:
    """Dense and sparse candidates of every query, fused, for all queries at once.

    ``queries`` and ``chunks``: ``id, dense, sparse``. Each list holds twice (with diversity three times) the limit.
    Both sides are scans of the chunks' vectors; no vector is shuffled, but for those of candidates under diversity.
    """
    depth = limit * (3 if use_mmr else 2)
    fused = fused_candidates(queries, chunks, depth, depth if use_mmr else limit, dim, rrf_k, rrf_base, ids_unique)
    return mmr(fused, _vec(queries), _vec(chunks), limit, lam) if use_mmr else fused


def _vec(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("dense").alias("vec"))


def fused_candidates(queries: DataFrame, chunks: DataFrame, depth: int, limit: int, dim: int = 384, rrf_k: int = RRF_K, rrf_base: int = RRF_BASE, ids_unique: bool = False) -> DataFrame:
    """The first ``limit`` of the fusion of a dense and a sparse list of ``depth`` hits per query."""
    from lodestack.operators.encoders import postings_of

    dense = dense_topk(_vec(queries), _vec(chunks), depth, dim)
    qt = postings_of(queries).select(F.col("id").alias("query_id"), "term", F.col("weight").cast("double").alias("qw"))
    qt = qt if ids_unique else qt.distinct()
    weights = chunks.select("id", F.col("sparse.indices").alias("terms"), F.col("sparse.values").alias("weights"))
    sparse = sparse_topk(qt, weights.where((F.size("terms") == F.size("weights")) & ~F.exists("weights", lambda w: w.isNull())), depth)
    return rrf_fuse([dense, sparse], rrf_k, rrf_base, limit)
