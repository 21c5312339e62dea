"""Text encoders behind one interface; the defaults need no model file.

An encoder maps a list of texts to vectors. Its factory is looked up by name on the driver and sent along; the encoder
is built once per Python worker, so a model-backed one can be registered in its place.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 384
SPARSE_TERMS = 30_522
_TERM = re.compile(r"[^\W\d_]+|\d+")


class HashingDense:
    """Signed feature hashing of words and word pairs, unit length; a text without words is all zero."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            w = _TERM.findall((t or "").lower())
            for f, n in Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]).items():
                h = xxhash.xxh3_64_intdigest(f)
                out[i, h % self.dim] += (1 if h >> 63 else -1) * (1 + math.log(n)) * (0.5 if " " in f else 1.0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class HashingSparse:
    """Weights log(1 + count) of hashed words: sorted indices, and values."""

    def __init__(self, n_terms: int = SPARSE_TERMS):
        self.n_terms = n_terms

    def __call__(self, texts: list[str | None]) -> list[dict]:
        out = []
        for t in texts:
            got: dict[int, int] = Counter(xxhash.xxh3_64_intdigest(w) % self.n_terms for w in _TERM.findall((t or "").lower()))
            at = sorted(got)
            out.append({"indices": at, "values": [math.log1p(got[i]) for i in at]})
        return out


REGISTRY: dict[str, Callable] = {"hashing-dense": HashingDense, "hashing-sparse": HashingSparse}
_built: dict[bytes, object] = {}


def register(name: str, factory: Callable) -> None:
    """Make an encoder known under a name: a callable without arguments that returns the encoder."""
    REGISTRY[name] = factory


def shipped(name: str) -> bytes:
    """The factory of that name, packed for the workers."""
    if name not in REGISTRY:
        raise KeyError(f"no encoder is registered as {name}")
    return cloudpickle.dumps(REGISTRY[name])


def built(factory: bytes):
    """The encoder of a packed factory, built at first use in this process."""
    if factory not in _built:
        _built[factory] = cloudpickle.loads(factory)()
    return _built[factory]


def encode(df: DataFrame, text: str, dense: str = "hashing-dense", sparse: str = "hashing-sparse") -> DataFrame:
    """``df`` with ``dense`` and ``sparse`` of a text column; both in one pass over the rows, so no join is needed."""
    keep = [c for c in df.columns if c not in ("dense", "sparse")]
    rows = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = keep.index(text)
    dense_factory, sparse_factory = shipped(dense), shipped(sparse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_dense, to_sparse = built(dense_factory), built(sparse_factory)
        kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
        for batch in batches:
            texts = batch.column(at).to_pylist()
            vectors = pa.array(list(to_dense(texts)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors, pa.array(to_sparse(texts), kind)], names=[*keep, "dense", "sparse"])

    return rows.mapInArrow(run, f"{schema}, dense array<float>, sparse struct<indices:array<int>,values:array<float>>")


def postings_of(chunks: DataFrame, id_col: str = "id", sparse: str = "sparse") -> DataFrame:
    """Long form of sparse vectors: ``id, term, weight``, zero and null weights left out."""
    pair = F.explode(F.arrays_zip(F.col(f"{sparse}.indices").alias("indices"), F.col(f"{sparse}.values").alias("values")))
    return chunks.select(F.col(id_col).alias("id"), pair.alias("p")).select("id", F.col("p.indices").alias("term"), F.col("p.values").alias("weight")).where("weight <> 0 AND term IS NOT NULL")
