"""Hierarchical chunking: parents, and children inside each parent, by recursive separators.

A text is cut at the first separator that occurs in it, which stays at the start of the following piece. Short
pieces are packed up to the size, with whole pieces of at most the overlap carried into the next chunk; pieces
above the size are cut by the remaining separators. A stretch without any separator stays whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators in order of preference, sizes and overlaps in characters.
SEPARATORS = ("\n\n", "\n", ". ", " ")
PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 1400, 200, 400, 80


def _pieces(text: str, sep: str) -> list[str]:
    head, *rest = text.split(sep)
    return [p for p in (head, *(sep + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    length = 0
    for p in pieces:
        if held and length + len(p) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.popleft())
        held.append(p)
        length += len(p)
    if held:
        yield "".join(held)


def split_by_separators(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where a separator allows it; stripped, blank ones dropped."""
    if not text:
        return []
    k = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    out: list[str] = []
    short: list[str] = []

    def flush() -> None:
        out.extend(_packed(short, size, overlap))
        short.clear()

    for p in _pieces(text, separators[k]):
        if len(p) < size:
            short.append(p)
            continue
        flush()
        if k + 1 < len(separators):
            out.extend(split_by_separators(p, size, overlap, separators[k + 1 :]))
        else:
            out.append(p)
    flush()
    return [c.strip() for c in out if c.strip()]


def hierarchical_chunks(text: str | None, parent: int = PARENT, child: int = CHILD, parent_overlap: int = PARENT_OVERLAP, child_overlap: int = CHILD_OVERLAP) -> Iterator[tuple[int, int, str, str]]:
    """(parent index, child index, parent text, child text)."""
    for i, p in enumerate(split_by_separators(text, parent, parent_overlap)):
        for j, c in enumerate(split_by_separators(p, child, child_overlap)):
            yield i, j, p, c


def chunk_texts(pages: DataFrame, key: str = "page_id", text: str = "content_text", parent: int = PARENT, child: int = CHILD, parent_overlap: int = PARENT_OVERLAP, child_overlap: int = CHILD_OVERLAP) -> DataFrame:
    """``key, parent_index, child_index, parent_text, child_text``; null and blank texts give no chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in hierarchical_chunks(t, parent, child, parent_overlap, child_overlap):
                    for c, v in zip(cols, (k, *row), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "parent_index", "child_index", "parent_text", "child_text"])

    rows = pages.select(F.col(key).cast("string").alias(key), text).where(F.length(text) > 0)
    return rows.mapInArrow(run, f"{key} string, parent_index int, child_index int, parent_text string, child_text string")
