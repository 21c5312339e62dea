"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words.

Every run of ``run`` consecutive words of an evaluation item is a pattern. A shift table over blocks of
``BLOCK`` words says how far the window may jump; at a block that ends a pattern, the block's bucket holds the
patterns, and a direct comparison of the words confirms an occurrence.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import words
from lodestack.runtime import BROADCAST_BYTES, cut_lineage

RUN = 12
BLOCK = 3
#: Patterns of one pass, at about 110 bytes each when packed, so that the tables sent at a time stay within
#: ``BROADCAST_BYTES``, which is checked; larger item tables are searched in several passes.
PATTERNS_PER_PASS = 200_000


class WuManber:
    """Shift table and buckets for all runs of ``run`` words of the given items."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN, block: int = BLOCK):
        self.run, self.block = run, min(block, run)
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[tuple[str, ...], set[int]]] = {}
        self.jump = run - self.block + 1
        for item, w in items:
            if len(w) < run:
                continue
            for i in range(len(w) - self.block + 1):
                block_at = tuple(w[i : i + self.block])
                # a block that has run - block words before it ends a pattern; earlier ones stand that much before an end
                distance = max(0, run - (i + self.block))
                if distance < self.shift.get(block_at, self.jump):
                    self.shift[block_at] = distance
            for i in range(len(w) - run + 1):
                pattern = tuple(w[i : i + run])
                self.buckets.setdefault(pattern[-self.block :], {}).setdefault(pattern, set()).add(item)

    def find(self, w: list[str]) -> set[int]:
        """Items of which some pattern occurs in the words."""
        run, block, jump, shift, buckets = self.run, self.block, self.jump, self.shift, self.buckets
        found: set[int] = set()
        end, n = run, len(w)
        if block == 3:
            get = shift.get
            while end <= n:
                key = (w[end - 3], w[end - 2], w[end - 1])
                step = get(key, jump)
                if step:
                    end += step
                    continue
                hit = buckets[key].get(tuple(w[end - run : end]))
                if hit:
                    found |= hit
                end += 1
            return found
        while end <= n:
            key = tuple(w[end - block : end])
            step = shift.get(key, jump)
            if step:
                end += step
                continue
            found |= buckets[key].get(tuple(w[end - run : end]), set())
            end += 1
        return found


def item_passes(items: DataFrame, run: int = RUN, most: int = PATTERNS_PER_PASS) -> Iterator[list[tuple[int, list[str]]]]:
    """Word lists of the items, in passes of at most ``most`` patterns; an item of more is cut into stretches that overlap by a pattern less a word."""
    part, size = [], 0
    for row in items.select("item_id", "item_text").where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).distinct().toLocalIterator():
        whole = words(row[1])
        for a in range(0, max(0, len(whole) - run + 1), most):
            w = whole[a : a + most + run - 1]
            n = len(w) - run + 1
            if part and size + n > most:
                yield part
                part, size = [], 0
            part.append((row[0], w))
            size += n
    if part:
        yield part


def search_tables(items: DataFrame, run: int, most: int, limit: int = BROADCAST_BYTES) -> Iterator[bytes]:
    """Packed search tables of all items, each within ``limit`` bytes; a pass of unusually long words is halved until it fits."""
    for part in item_passes(items, run, most):
        todo = [part]
        while todo:
            now = todo.pop()
            packed = pickle.dumps(WuManber(now, run))
            if len(packed) <= limit or (len(now) == 1 and len(now[0][1]) <= run):
                yield packed
                continue
            if len(now) > 1:
                todo += [now[: len(now) // 2], now[len(now) // 2 :]]
            else:
                (item, w), half = now[0], (len(now[0][1]) - run + 1) // 2
                todo += [[(item, w[: half + run - 1])], [(item, w[half:])]]


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Pairs of a document and an item that share ``run`` consecutive words.

    Null texts, texts and items of fewer words, and null ids give no rows; extra columns are ignored; repeated
    documents or items give one row per pair. The item table is read in passes of bounded size, each searched in
    all documents, whose words are found once: where there are several passes, they are written first. Result:
    ``doc_id, item_id``.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    out, split, first = None, words, None
    for packed in search_tables(items, run, PATTERNS_PER_PASS):
        if first is None:
            first = packed  # held back until it is known whether there are more
            continue
        if out is None:
            docs, split = cut_lineage(_worded(docs)), str.split
            out = _searched(docs, first, split)
        out = out.unionByName(_searched(docs, packed, split))
    if out is None and first is not None:
        out = _searched(docs, first, split)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()


def _worded(docs: DataFrame) -> DataFrame:
    """The documents' words, parted by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(words(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


def _searched(docs: DataFrame, packed: bytes, split: Callable[[str], list[str]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = pickle.loads(sent.value)
        for batch in batches:
            ids, hits = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for item in search.find(split(text)):
                    ids.append(doc)
                    hits.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(scan, "doc_id long, item_id long")


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Documents per item and suite; items without a leak count 0."""
    n = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    known = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max("suite").alias("suite"))
    return known.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))
