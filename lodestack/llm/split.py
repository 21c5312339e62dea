"""Splitting oversized texts at natural boundaries by structure-tree packing.

A text is parsed into a tree: sections by headings, blocks by blank lines, list items, lines, sentences,
words. Sibling subtrees are merged up to the size limit; only nodes above the limit are descended into.
A cut inside a word ("forced") happens only to words longer than the limit itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import row_key

PAGE_LIMIT, PARENT_LIMIT, CHUNK_LIMIT = 1400, 1400, 400
PAGE_OVERLAP, PARENT_OVERLAP, CHUNK_OVERLAP = 200, 200, 80

_HEADING = re.compile(r"^[ \t]*(?:(#{1,6})[ \t]|h([1-6])\. |(={2,6})[^=\n]+=+[ \t]*$|\\((?:sub)*)section\b|<h([1-6])\b)", re.M | re.I)
_BLOCK = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"^[ \t]*(?:[-*+•][ \t]|\d{1,3}[.)][ \t]|\\item\b)", re.M)
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?…]['\"”’)\]]*\s+")
_WORD = re.compile(r"\s+")

Span = tuple[int, int]


def _level(m: re.Match) -> int:
    if m.group(1):
        return len(m.group(1))
    if m.group(2) or m.group(5):
        return int(m.group(2) or m.group(5))
    if m.group(3):
        return len(m.group(3))
    return 1 + len(m.group(4) or "") // 3


def _by_ends(rx: re.Pattern, text: str, a: int, b: int) -> list[Span]:
    """Tiles of [a, b) that end behind each match."""
    cuts = [m.end() for m in rx.finditer(text, a, b) if a < m.end() < b]
    return list(zip([a, *cuts], [*cuts, b], strict=True))


def _by_starts(rx: re.Pattern, text: str, a: int, b: int) -> list[Span]:
    """Tiles of [a, b) that start at each match."""
    cuts = [m.start() for m in rx.finditer(text, a, b) if a < m.start() < b]
    return list(zip([a, *cuts], [*cuts, b], strict=True))


def _sections(text: str, a: int, b: int) -> list[Span]:
    """Tiles at the headings of the highest level present, so that nesting follows the heading levels."""
    found = [(m.start(), _level(m)) for m in _HEADING.finditer(text, a, b)]
    inner = [(s, n) for s, n in found if s > a]
    if not inner:
        return [(a, b)]
    top = min(n for _, n in inner)
    cuts = [s for s, n in inner if n == top]
    return list(zip([a, *cuts], [*cuts, b], strict=True))


_CHILDREN = (
    _sections,
    lambda t, a, b: _by_ends(_BLOCK, t, a, b),
    lambda t, a, b: _by_starts(_ITEM, t, a, b),
    lambda t, a, b: _by_ends(_LINE, t, a, b),
    lambda t, a, b: _by_ends(_SENTENCE, t, a, b),
    lambda t, a, b: _by_ends(_WORD, t, a, b),
)


def _solid(text: str, a: int, b: int) -> int:
    """Length of a span without its trailing whitespace."""
    while b > a and text[b - 1].isspace():
        b -= 1
    return b - a


def _pack(text: str, a: int, b: int, depth: int, limit: int, room: int, out: list[tuple[int, int, bool]]) -> None:
    """Append the pieces of [a, b), as (start, end, ends inside a word)."""
    if _solid(text, a, b) <= room:
        out.append((a, b, False))
        return
    if depth == len(_CHILDREN):  # one word
        n = _solid(text, a, b)
        if n <= limit:
            out.append((a, b, False))
            return
        at = a
        while _solid(text, at, b) > room:
            out.append((at, at + room, True))
            at += room
        out.append((at, b, False))
        return
    kids = _CHILDREN[depth](text, a, b)
    if len(kids) == 1:
        _pack(text, a, b, depth + 1, limit, room, out)
        return
    start = end = None
    for x, y in kids:
        if start is not None and _solid(text, start, y) <= room:
            end = y
            continue
        if start is not None:
            out.append((start, end, False))
            start = None
        if _solid(text, x, y) <= room:
            start, end = x, y
        else:
            _pack(text, x, y, depth if depth == 0 and (x, y) != (a, b) else depth + 1, limit, room, out)
            if out and not out[-1][2] and _solid(text, *out[-1][:2]) <= room // 4:  # a short rest joins the siblings behind it
                start, end, _ = out.pop()
    if start is not None:
        out.append((start, end, False))


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces of a text as (start, end, cut): code-point offsets and how the piece ends.

    ``cut`` is 'end' for the last piece, 'forced' for a cut inside a word, else 'natural'. No piece is longer
    than ``limit``; a piece starts up to ``overlap`` before the end of the previous one, at a word start where
    there is one, and by less only where a word needs the room. A text within the limit is one piece.
    """
    a, b = 0, len(text)
    while a < b and text[a].isspace():
        a += 1
    b = a + _solid(text, a, b)
    if b - a <= limit:
        return [(a, b, "end")] if b > a else []
    cores: list[tuple[int, int, bool]] = []
    _pack(text, a, b, 0, limit, max(1, limit - overlap), cores)
    out = []
    for i, (s, e, forced) in enumerate(cores):
        e = s + _solid(text, s, e)
        if i and overlap:
            lo = max(s - overlap, e - limit, out[-1][0] + 1)
            if lo < s:
                gap = _WORD.search(text, max(lo - 1, 0), s)
                s = max(lo, gap.end()) if gap and gap.end() < s else (lo if cores[i - 1][2] else s)
        while s < e and text[s].isspace():
            s += 1
        out.append((s, e, "forced" if forced else "natural"))
    s, e, _ = out[-1]
    out[-1] = (s, e, "end")
    return out


_PIECES = "item_kind string, item_key string, piece_no int, start_at int, end_at int, cut string, piece string"


def split_items(items: DataFrame, with_text: bool = True) -> DataFrame:
    """Cut every item above its limit into ordered pieces.

    ``items``: ``item_kind, item_key, text, size_limit, overlap`` (other columns are ignored). Items whose text is
    null or, without outer whitespace, within the limit give no rows. Repeated rows are cut once per batch and
    give equal rows. Result: one row per piece; ``piece`` is null unless ``with_text``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_kind", pa.string()), ("item_key", pa.string()), ("piece_no", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("cut", pa.string()), ("piece", pa.string())])
        for batch in batches:
            kinds, keys, texts, limits, overlaps = (batch.column(i).to_pylist() for i in range(5))
            cols: list[list] = [[], [], [], [], [], [], []]
            seen: set = set()
            for kind, key, text, limit, overlap in zip(kinds, keys, texts, limits, overlaps, strict=True):
                if (kind, key, text) in seen:  # all children of a parent carry its text
                    continue
                seen.add((kind, key, text))
                pieces = split_text(text, limit, overlap)
                if len(pieces) > 1:
                    for no, (s, e, how) in enumerate(pieces):
                        for c, v in zip(cols, (kind, key, no, s, e, how, text[s:e] if with_text else None), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    cols = ["item_kind", "item_key", "text", "size_limit", "overlap"]
    large = items.select(*cols).where(F.length("text") > F.col("size_limit"))  # whitespace can only shorten a text
    return large.mapInArrow(cut, _PIECES)


def unique_items(items: DataFrame) -> DataFrame:
    """The items above their limit, each text of a kind and key once; the texts are told apart by two 64-bit hashes."""
    large = items.where(F.length("text") > F.col("size_limit"))
    keys = ["item_kind", "item_key", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    return large.groupBy(*keys).agg(F.first("text").alias("text"), F.first("size_limit").alias("size_limit"), F.first("overlap").alias("overlap")).drop("h1", "h2")


def wiki_items(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts that have a size limit in this project."""

    def part(df: DataFrame, kind: str, key, text: str, limit: int, overlap: int) -> DataFrame:
        return df.select(F.lit(kind).alias("item_kind"), key.alias("item_key"), F.col(text).alias("text"), F.lit(limit).alias("size_limit"), F.lit(overlap).alias("overlap"))

    return (
        part(pages, "page", row_key("page_id", "version"), "content_text", PAGE_LIMIT, PAGE_OVERLAP)
        .unionByName(part(chunks, "parent", row_key("page_id", "parent_index"), "parent_text", PARENT_LIMIT, PARENT_OVERLAP))
        .unionByName(part(chunks, "chunk", F.coalesce(F.col("id"), F.lit("")), "chunk", CHUNK_LIMIT, CHUNK_OVERLAP))
    )


def oversized_items(pieces: DataFrame) -> DataFrame:
    """One row per item that was cut: ``cut_kind`` is 'forced' if any of its cuts is, else 'natural'."""
    forced = F.max(F.when(F.col("cut") == "forced", 1).otherwise(0))
    return pieces.groupBy("item_kind", "item_key").agg(F.when(forced == 1, "forced").otherwise("natural").alias("cut_kind"))
