"""Near-duplicate records: set similarity join with adaptive multi-match prefixes.

A record is the set of its runs of ``width`` words. All sets are ordered by one global order, rarest runs first, so
two similar sets must share runs in short prefixes. A record whose prefix promises many candidates gets a longer
prefix and demands more shared runs before a pair is verified. Runs fall into ``GROUPS`` groups: a pair that must
share ``GROUPS * (k - 1) + 1`` runs has a group in which it shares ``k``, so matches are counted inside the groups.
Groups report pairs from ``k - 1`` matches on, and the reports of all groups bound a pair's shared runs from above.

Where a group of a size band holds more than ``CELL_RUNS`` runs, it is split by run into cells. A record's runs of the
group are written whole to each cell that one of them falls into, and a pair is counted in the cell of its least shared
run, so that a record is written at most once for each of its prefix runs and band (two bands at a similarity of at
least one half), however large the collection is, and no match leaves its cell. Only a run that more than ``TILE_RECORDS`` records
hold is cut further: its holders are compared in tiles of two blocks of them, for which the postings of these holders
(no others) are written once per block, ``m / TILE_RECORDS`` times for a run of ``m`` holders.

Where the vocabulary of runs does not grow with the collection, a record meets a fixed share of all others in its
prefix, and matches cost more than comparing every two records. Such size bands, found by the estimated matches of a
sample, are compared directly: a record is a parity bitmap of its runs, whose differing bits bound the runs that two
records do not share from below, so no similar pair is lost. The work is the square of a band's records, at a few words
a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.words import WordIds, shingles, words
from lodestack.runtime import cut_lineage

#: Fixed values of the wiki's pages: three words, half of all runs.
PAGE_WIDTH, PAGE_SIMILARITY = 3, Fraction(1, 2)
#: Corpus default: five words, similarity 0.8.
WIDTH, SIMILARITY = 5, Fraction(4, 5)
GROUPS = 16
#: Counters (a power of two) of the frequency sketch that orders the runs, least and most; the most bounds what is broadcast.
SKETCH_BITS, MAX_SKETCH_BITS = 20, 22
#: Occurrences of runs for which the sketch has one counter.
RUNS_PER_COUNTER = 1_000
#: Estimated prefix matches above which a record takes the next longer prefix.
COSTS = (2.0, 200.0, 10_000.0)
#: Runs that one task counts, about.
CELL_RUNS = 2_000_000
#: Records of one run that one task compares; a run of more is compared in tiles of two blocks of its records.
TILE_RECORDS = 100_000
#: Words of bitmaps that are compared in the time of one match of the prefixes, about.
WORDS_A_MATCH = 40
#: Records of a band whose matches are estimated.
ESTIMATED = 2_000
#: Records that a task compares with each other by bitmaps; a band of more is compared in tiles of two blocks of them.
BLOCK_RECORDS = 100_000
#: Exact copies up to this number are written out as pairs; more copies are linked to their least id.
COPIES = 64
#: Pairs that a group counts at a time.
PAIRS_AT_ONCE = 3_000_000


def need(n: np.ndarray, m: np.ndarray, s: Fraction) -> np.ndarray:
    """Least overlap of two sets of ``n`` and ``m`` runs of similarity ``s``: s / (1 + s) of their sizes' sum."""
    q = s / (1 + s)
    return -(-(n + m) * q.numerator // q.denominator)


def extension(k: np.ndarray | int) -> np.ndarray | int:
    """Shared prefix runs that guarantee ``k`` of them in one group."""
    return GROUPS * (k - 1) + 1


def reported(k: np.ndarray) -> np.ndarray:
    """Matches from which on a group reports a pair."""
    return np.maximum(1, k - 1)


def split_of(toks: np.ndarray, splits: int) -> np.ndarray:
    """Cell of a run within its group, of ``splits`` (a power of two)."""
    return ((toks.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(12)).astype(np.int64) & (splits - 1)


def record_sets(records: DataFrame, key: str, title: str | None, text: str, width: int) -> DataFrame:
    """``key, same, copy, runs``: the sorted distinct runs of every record, a hash of them all, and one of title and text; without runs, no row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            keys, same, copy, runs = [], [], [], []
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                r = np.unique(shingles(ids(words(f"{a or ''} {b}")), width))
                if len(r):
                    keys.append(k)
                    same.append(xxhash.xxh3_64_intdigest(r))
                    copy.append(xxhash.xxh3_64_intdigest(f"{len(a or '')} {a or ''}{b}"))
                    runs.append(r.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            flat = np.concatenate(runs) if runs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (same, copy)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "same", "copy", "runs"])

    rows = records.select(F.col(key).cast("string").alias("key"), (F.col(title) if title else F.lit(None)).cast("string").alias("title"), F.col(text).alias("text"))
    return rows.where(F.col("key").isNotNull() & (F.trim("text") != "")).mapInArrow(sets, "key string, same long, copy long, runs array<long>")


def frequency_sketch(sets: DataFrame, n_runs: int = 0) -> np.ndarray:
    """How often runs occur, over all records, in counters of a bounded number; equal runs share one."""
    bits = min(MAX_SKETCH_BITS, max(SKETCH_BITS, (n_runs // RUNS_PER_COUNTER).bit_length()))
    low = F.explode("runs").alias("run")
    counted = sets.select(low).groupBy(F.col("run").bitwiseAND((1 << bits) - 1).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    got = counted.toArrow()
    sketch = np.zeros(1 << bits, dtype=np.int64)
    sketch[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(sketch, 2**31 - 1).astype(np.int32)


def band_of(n: int) -> int:
    """Band of a set's size; similar sets of at least half are in one band or in neighbours."""
    return n.bit_length() - 1


def prefix_of(runs: np.ndarray, sketch: np.ndarray, s: Fraction, costs: tuple[float, ...] = COSTS) -> tuple[np.ndarray, int]:
    """The prefix of a set in the global order, and the ``k`` that was chosen by estimated cost."""
    df = sketch[runs & (len(sketch) - 1)]
    order = np.lexsort((runs, df))
    n = len(runs)
    least = int(need(np.int64(n), np.int64(-(-n * s.numerator // s.denominator)), s))  # with the smallest partner
    base = n - least
    k_most = 1 + max(0, (least - 1) // GROUPS)
    matches = float(df[order[: base + 1]].astype(np.int64).sum() - (base + 1))
    k = min(k_most, 1 + int(np.searchsorted(costs, matches)))
    return runs[order[: min(n, base + extension(k))]], k


def _place_type(n: int) -> type:
    """Places within a set of ``n`` runs take two bytes where they fit."""
    return np.uint16 if n < 1 << 16 else np.int32


def _postings(sent, s: Fraction, costs: tuple[float, ...], tile_records: int, left_out: frozenset[int] = frozenset()):
    reach = band_of(-(-s.denominator // s.numerator) * 2 - 1)  # bands between a set and its smallest partner

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, splits = sent.value
        mask = len(sketch) - 1
        seen: set[int] = set()
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]

            def put(*row) -> None:
                for c, v in zip(cols, row, strict=True):
                    c.append(v)

            for same, runs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if same in seen:
                    continue
                seen.add(same)
                r = runs.values.to_numpy()
                n = len(r)
                bands = [b for b in range(band_of(n), max(-1, band_of(n) - reach - 1), -1) if b not in left_out]
                if not bands:
                    continue
                prefix, k = prefix_of(r, sketch, s, costs)
                place = np.arange(len(prefix), dtype=_place_type(n))
                group = (prefix >> 33) & (GROUPS - 1)
                hot = sketch[prefix & mask] > tile_records
                # smaller partners are compared in their band
                for b in bands:
                    by = np.argsort(group, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))
                    n_splits = splits.get(b, 1)
                    for at in np.split(by, starts[1:]):
                        toks = (prefix[at] & 0xFFFFFFFF).astype(np.uint32)
                        data = toks.tobytes() + place[at].tobytes()
                        cell = b << 56 | int(group[at[0]]) << 28
                        for part in np.unique(split_of(toks[~hot[at]], n_splits)).tolist() if n_splits > 1 else (0,):
                            put(cell | part << 32, 0, same, n << 8 | k, data)
                        for h in prefix[at][hot[at]]:
                            blocks = tiles_of(int(sketch[h & mask]), tile_records)
                            mine = same % blocks
                            for other in range(blocks):
                                put(cell | min(mine, other) * blocks + max(mine, other), int(h & 0xFFFFFFFF) + 1, same, n << 8 | k, data)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cell", "hot", "same", "nk", "data"])

    return prefixes


def tiles_of(records: int, tile_records: int) -> int:
    """Blocks of the records of one run."""
    return -(-records // tile_records)


def bitmap_words(band: int) -> int:
    """Words of the bitmaps of a band: eight bits for each run of its least set."""
    return max(4, (8 << band) // 64)


def bitmap_of(runs: np.ndarray, words_: int) -> np.ndarray:
    """Of every bit the parity of the runs that fall on it."""
    bits = ((runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % (64 * words_)
    return np.packbits((np.bincount(bits, minlength=64 * words_) & 1).astype(np.uint8)).view(np.uint64)


def _bitmaps(bands: dict[int, int], s: Fraction):
    """Bitmaps of every set for the bands in which it is compared; ``bands``: blocks of each."""
    reach = band_of(-(-s.denominator // s.numerator) * 2 - 1)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cells, sames, sizes, data = [], [], [], []
            for same, runs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if same in seen:
                    continue
                seen.add(same)
                r = runs.values.to_numpy()
                for b in range(band_of(len(r)), max(-1, band_of(len(r)) - reach - 1), -1):
                    if b in bands:
                        bits, mine = bitmap_of(r, bitmap_words(b)).tobytes(), same % bands[b]
                        for other in range(bands[b]):
                            cells.append(b << 48 | min(mine, other) << 24 | max(mine, other))
                            sames.append(same)
                            sizes.append(len(r))
                            data.append(bits)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(sames, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["cell", "same", "n", "bits"])

    return maps


def _compare(one: tuple, other: tuple, band: int, s: Fraction, ties: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a set of ``one`` in the band and a set of ``other`` of its size or more that may be similar.

    Both are sorted by size; ``ties``: whether sets of equal size are paired. The same object twice pairs each two once.
    """
    (same, n, bits), (same_y, m, bits_y) = one, other
    found: list[tuple[np.ndarray, np.ndarray]] = [(same[:0], same[:0])]
    step, wide, n_words = 32, 2048, len(bits)
    mixed, count, few, sums = (np.empty((step, wide), t) for t in (np.uint64, np.uint8, np.uint8, np.uint16))
    for a in range(int(np.searchsorted(n, 1 << band)), int(np.searchsorted(n, 1 << (band + 1))), step):
        z = min(a + step, int(np.searchsorted(n, 1 << (band + 1))))
        lo = a + 1 if one is other else int(np.searchsorted(m, n[a], "left" if ties else "right"))
        hi = int(np.searchsorted(m, n[z - 1] * s.denominator // s.numerator, "right"))
        for c in range(lo, hi, wide):
            e = min(c + wide, hi)
            total = n[z - 1] + m[e - 1]
            most = int(total - 2 * need(n[z - 1], m[e - 1], s)) + 1  # runs that a similar pair does not share, at most
            unlike = 32 * n_words * -np.expm1(-2 * float(total) / (64 * n_words))  # bits that differ between unlike sets
            w = min(n_words, int(n_words * 1.15 * most / unlike) + 1)
            x, y, three, apart = (v[: z - a, : e - c] for v in (mixed, count, few, sums))
            apart[:] = 0
            for k in range(w):
                np.bitwise_xor(bits[k, a:z, None], bits_y[k, None, c:e], out=x)
                np.bitwise_count(x, out=y if k % 3 else three)
                if k % 3:
                    np.add(three, y, out=three)  # the counts of three words fit into a byte
                if k % 3 == 2 or k + 1 == w:
                    np.add(apart, three, out=apart)
            i, j = np.nonzero(apart <= most)
            apart = apart[i, j].astype(np.int64)
            i, j = i + a, j + c
            most = n[i] + m[j] - 2 * need(n[i], m[j], s)
            for k in range(w, n_words):
                if not len(i):
                    break
                apart += np.bitwise_count(bits[k, i] ^ bits_y[k, j])
                good = apart <= most
                i, j, apart, most = i[good], j[good], apart[good], most[good]
            good = apart <= most
            i, j = i[good], j[good]
            good = (m[j] * s.numerator <= n[i] * s.denominator) & ((j > i) if one is other else (m[j] >= n[i]) if ties else (m[j] > n[i]))
            found.append((same[i[good]], same_y[j[good]]))
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    return np.minimum(x, y), np.maximum(x, y)


def _compare_cell(table: pa.Table, bands: dict[int, int], s: Fraction) -> pa.Table:
    """Pairs of a tile whose bitmaps leave it open that they are similar."""
    cell = table.column("cell")[0].as_py()
    band, first, second = cell >> 48, cell >> 24 & (1 << 24) - 1, cell & (1 << 24) - 1
    same = table.column("same").to_numpy()
    _, at = np.unique(same, return_index=True)  # a class may come from several tasks
    at = at[np.argsort(table.column("n").to_numpy()[at], kind="stable")]
    same, n = same[at], table.column("n").to_numpy()[at]
    bits = np.ascontiguousarray(np.frombuffer(b"".join(table.column("bits").take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1).T)
    if first == second:
        all_ = same, n, bits
        pairs = [_compare(all_, all_, band, s, True)]
    else:
        x, y = ((same[k], n[k], np.ascontiguousarray(bits[:, k])) for k in (same % bands[band] == first, same % bands[band] == second))
        pairs = [_compare(x, y, band, s, True), _compare(y, x, band, s, False)]
    a, b = (np.concatenate(v) for v in zip(*pairs, strict=True))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crowded_bands(sets: DataFrame, sent, s: Fraction, records_in: dict[int, int]) -> dict[int, int]:
    """Bands in which bitmaps cost less than the estimated matches of the prefixes, with the blocks of their records."""
    share = {b: min(1.0, ESTIMATED / n) for b, n in records_in.items()}
    reach = band_of(-(-s.denominator // s.numerator) * 2 - 1)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = sent.value[0]
        sums: dict[int, int] = {}
        for batch in batches:
            for same, runs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if same % 1_000_003 < share[b := band_of(len(runs))] * 1_000_003:
                    prefix, _ = prefix_of(runs.values.to_numpy(), sketch, s)
                    sums[b] = sums.get(b, 0) + int(sketch[prefix & (len(sketch) - 1)].astype(np.int64).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["band", "n"])

    found = sets.select("same", "runs").mapInArrow(estimate, "band int, n long").groupBy("band").agg(F.sum("n").alias("n")).collect()
    matches = {r.band: r.n / share[r.band] for r in found}
    out = {}
    for b, own in records_in.items():
        near = sum(records_in.get(c, 0) for c in range(b, b + reach + 1))
        if matches.get(b, 0) * WORDS_A_MATCH > own * near * bitmap_words(b):
            out[b] = -(-near // BLOCK_RECORDS)
    return out


def _least_common(a: frozenset, b: frozenset) -> int:
    return min(a & b, default=-1)


def _count_cell(table: pa.Table, s: Fraction, sent, tile_records: int) -> pa.Table:
    """Pairs of a cell that share enough prefix runs there to be reported.

    A pair that shares hot runs is counted in the tiles of the least of them, any other in the plain cell.
    """
    sketch, splits = sent.value
    out = {"a": [], "b": [], "hits": [], "k": []}
    cell, tile_run = table.column("cell")[0].as_py(), table.column("hot")[0].as_py() - 1
    band, tile = cell >> 56, cell & (1 << 28) - 1
    n_splits, part = splits.get(band, 1) if tile_run < 0 else 1, cell >> 32 & (1 << 24) - 1
    n_blocks = tiles_of(int(sketch[tile_run & len(sketch) - 1]), tile_records) if tile_run >= 0 else 1
    one, other = divmod(tile, n_blocks)
    same = table.column("same").to_numpy()
    _, first = np.unique(same, return_index=True)  # a class may come from several tasks
    nk = table.column("nk").to_numpy()[first]
    same, size, k = same[first], nk >> 8, nk & 255
    toks, places = [], []
    for x, n in zip(table.column("data").take(pa.array(first)).to_pylist(), size, strict=True):
        kind = np.dtype(_place_type(n))
        m = len(x) // (4 + kind.itemsize)
        toks.append(np.frombuffer(x, np.uint32, m))
        places.append(np.frombuffer(x, kind, m, 4 * m))
    hots = [frozenset(t[sketch[t & len(sketch) - 1] > tile_records].tolist()) for t in toks]
    some_hot = any(hots)
    block = same % n_blocks
    doc = np.repeat(np.arange(len(same)), [len(x) for x in toks])
    tok, place = np.concatenate(toks).astype(np.int64), np.concatenate(places).astype(np.int64)
    if some_hot and tile_run < 0:  # hot runs match in their own tiles
        cold = sketch[tok & len(sketch) - 1] <= tile_records
        doc, tok, place = doc[cold], tok[cold], place[cold]
    n, ext = size[doc], extension(k)[doc]
    order = np.lexsort((doc, n, tok))
    tok, place, doc, n, ext = tok[order], place[order], doc[order], n[order], ext[order]
    key = (tok << 28) | np.minimum(n, (1 << 28) - 1)
    widest = n * s.denominator // s.numerator
    stop = np.searchsorted(key, (tok << 28) | np.minimum(widest, (1 << 28) - 1), side="right")
    # the smaller set of a pair needs its run within the prefix for a partner of its own size or more
    here = (n >= 1 << band) & (n < 1 << (band + 1))
    small = np.flatnonzero(here & (place < n - need(n, n, s) + ext))
    fan = stop[small] - small - 1
    small, fan = small[fan > 0], fan[fan > 0]
    by_doc = np.argsort(doc[small], kind="stable")
    small, fan = small[by_doc], fan[by_doc]
    d = doc[small]
    starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.empty(0, np.int64)
    upto = np.concatenate([np.cumsum(fan)[starts[1:] - 1], [fan.sum()]]) if len(starts) else np.empty(0)
    a = 0
    while a < len(starts):  # all matches of a document are counted at a time
        before = upto[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(upto, before + PAIRS_AT_ONCE, side="right")))
        i0, i1 = starts[a], starts[z] if z < len(starts) else len(small)
        i = np.repeat(small[i0:i1], fan[i0:i1])
        offset = np.arange(len(i)) - np.repeat(np.cumsum(fan[i0:i1]) - fan[i0:i1], fan[i0:i1])
        j = i + 1 + offset
        o = need(n[i], n[j], s)
        e = np.minimum(ext[i], ext[j])
        good = (place[i] < n[i] - o + e) & (place[j] < n[j] - o + e) & (doc[i] != doc[j])
        if one != other:  # pairs inside a block belong to the block's own tile
            good &= block[doc[i]] != block[doc[j]]
        pair = doc[i][good] * len(same) + doc[j][good]
        if n_splits > 1:  # the cell of the least shared run counts the pair
            run = tok[i][good]
            by = np.lexsort((run, pair))
            pair, run = pair[by], run[by]
            at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
            hits = np.diff([*at, len(pair)])
            mine = split_of(run[at], n_splits) == part
            pair, hits = pair[at][mine], hits[mine]
        else:
            pair, hits = np.unique(pair, return_counts=True)
        x, y = pair // len(same), pair % len(same)
        kk = np.minimum(k[x], k[y])
        enough = hits >= reported(kk)
        if some_hot:
            enough[enough] = [_least_common(hots[p], hots[q]) == tile_run for p, q in zip(x[enough], y[enough], strict=True)]
        x, y, kk, hits = x[enough], y[enough], kk[enough], hits[enough]
        out["a"].append(np.minimum(same[x], same[y]))
        out["b"].append(np.maximum(same[x], same[y]))
        out["hits"].append(hits)
        out["k"].append(kk)
        a = z
    return pa.table({c: pa.array(np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64)) for c, v in out.items()})


def similar_classes(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs ``a < b`` of different sets (by hash) of at least the similarity; ``sets`` is read several times."""
    spark = sets.sparkSession
    bands = sets.groupBy(F.floor(F.log2(F.size("runs"))).cast("int").alias("band")).agg(F.sum(F.size("runs")).alias("n"), F.count("*").alias("records")).collect()  # a few dozen
    runs_in = {r.band: r.n for r in bands}
    most = GROUPS * CELL_RUNS
    splits = {b: 1 << max(0, (-(-(runs_in.get(b, 0) + runs_in.get(b + 1, 0)) // most) - 1).bit_length()) for b in range(max(runs_in, default=0) + 1)}
    tile_records = TILE_RECORDS
    sent = spark.sparkContext.broadcast((frequency_sketch(sets, sum(runs_in.values())), splits))
    crowded = crowded_bands(sets, sent, similarity, {r.band: r.records for r in bands})
    postings = sets.select("same", "runs").mapInArrow(_postings(sent, similarity, COSTS, tile_records, frozenset(crowded)), "cell long, hot long, same long, nk long, data binary")
    counted = postings.groupBy("cell", "hot").applyInArrow(lambda t: _count_cell(t.combine_chunks(), similarity, sent, tile_records), "a long, b long, hits long, k long")
    sums = counted.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.count("*").alias("groups"), F.max("k").alias("k"))
    silent = F.greatest(F.lit(1), F.col("k") - 1) - 1  # most matches of a group that did not report
    pairs = sums.where(F.col("hits") + (GROUPS - F.col("groups")) * silent >= GROUPS * (F.col("k") - 1) + 1).select("a", "b")
    if crowded:
        maps = sets.select("same", "runs").mapInArrow(_bitmaps(crowded, similarity), "cell long, same long, n long, bits binary")
        tiles = sum(n * (n + 1) // 2 for n in crowded.values())
        maps = maps.repartition(4 * tiles, "cell")  # tiles take long for their bytes, so few should share a task
        pairs = pairs.unionByName(maps.groupBy("cell").applyInArrow(lambda t: _compare_cell(t.combine_chunks(), crowded, similarity), "a long, b long"))
    q = similarity / (1 + similarity)
    # one row per class, placed by class once for both joins
    runs = sets.groupBy("same").agg(F.first("runs").alias("runs"))
    left = pairs.join(runs.select(F.col("same").alias("a"), F.col("runs").alias("ra")), "a")
    both = left.join(runs.select(F.col("same").alias("b"), F.col("runs").alias("rb")), "b")
    shared = F.size(F.array_intersect("ra", "rb"))
    return both.where(shared * q.denominator >= (F.size("ra") + F.size("rb")) * q.numerator).select("a", "b").distinct()


def current_pages(pages: DataFrame) -> DataFrame:
    """The row of the highest version of every page; among equal versions the one of least text hash."""
    row = F.struct("title", "content_text")
    by = F.struct(F.coalesce("version", F.lit(-1)), F.xxhash64("title", "content_text"))
    return pages.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max_by(row, by).alias("r")).select("page_id", "r.title", "r.content_text")


def near_duplicates(records: DataFrame, key: str, title: str | None, text: str, width: int = WIDTH, similarity: Fraction = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Membership (``key, same, copy``: records of equal sets share ``same``, exact copies ``copy``) and the links ``a, b`` between classes.

    Null keys, null or blank texts, and texts of fewer words than ``width`` give no rows; a null title is the empty
    text; repeated rows count once; extra columns are ignored; no link between different sets is lost.
    """
    sets = cut_lineage(record_sets(records, key, title, text, width))
    return sets.select("key", "same", "copy").distinct(), similar_classes(sets, similarity)


def pairs_of(members: DataFrame, links: DataFrame, copies: int = COPIES) -> DataFrame:
    """Pairs ``key_a < key_b``. More than ``copies`` exact copies stand with their least key, to which each of them is linked."""
    sized = members.groupBy("same", "copy").agg(F.count("*").alias("m"), F.min("key").alias("rep"))
    of = members.join(sized, ["same", "copy"])
    spread = of.where((F.col("m") <= copies) | (F.col("key") == F.col("rep"))).select("same", "key")
    across = links.join(spread.select(F.col("same").alias("a"), F.col("key").alias("x")), "a").join(spread.select(F.col("same").alias("b"), F.col("key").alias("y")), "b").select("x", "y")
    inside = spread.select("same", F.col("key").alias("x")).join(spread.select("same", F.col("key").alias("y")), "same").where("x < y").select("x", "y")
    star = of.where((F.col("m") > copies) & (F.col("key") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("key").alias("y"))
    both = across.unionByName(inside).unionByName(star)
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).where("key_a <> key_b").distinct()


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, group_id, n_links``: connected groups of records by least class, and the links of each record's class.

    Labels only fall, and rounds go on until none moves.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct())
    label = cut_lineage(both.select(F.col("a").alias("node")).distinct().withColumn("low", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("around"))
        step = label.join(near, "node")
        # the class that was the label is told as well, and with it all that have this label
        told = step.where("around < low").groupBy(F.col("low").alias("node")).agg(F.min("around").alias("told"))
        least = F.least("low", "around", "told")
        step = step.join(told, "node", "left").select("node", least.alias("low"), (least < F.col("low")).alias("moved"))
        # follow the label of the label, which halves the way
        hop = step.select(F.col("node").alias("low"), F.col("low").alias("next"))
        step = cut_lineage(step.join(hop, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("low"), "moved"))
        label = step.select("node", "low")
        if not step.where("moved").limit(1).count():
            break
    degree = both.groupBy(F.col("a").alias("same")).agg(F.count("*").alias("n_links"))
    known = members.select("key", "same").distinct().join(label.select(F.col("node").alias("same"), "low"), "same", "left").join(degree, "same", "left")
    known = known.withColumn("low", F.coalesce("low", "same"))
    least = known.groupBy("low").agg(F.min("key").alias("group_id"))
    return known.join(least, "low").select("key", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
