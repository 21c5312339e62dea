"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

Weights go down the tree; what a leaf cannot fill is redistributed among its siblings before it reaches their
ancestors. Each leaf then takes whole seeded epochs of its documents and a token-prefix of one more epoch.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.runtime import cut_lineage

#: Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of the epoch order; only the one range of a leaf where its budget ends is sorted.
RANGES = 4096
#: Leaves are (source, language) pairs of the target table; more than this are an error of the input.
MAX_LEAVES = 100_000

_encodings: dict[str, object] = {}


def encoding(path: str):
    """Tokenizer of a vocabulary file, loaded once per Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def source_name(c: Column) -> Column:
    """Source in one spelling: lower case, single hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-")


def language_name(c: Column) -> Column:
    """Primary language subtag, 'und' for none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1), F.lit("")), F.lit("und"))


def domain_name(source: str) -> str:
    """Domain of a source: the kind of text, which its name ends with."""
    return source.rpartition("-")[2] or source


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens`` of every document with an id, a source and a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("lang"), "text")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    counted = rows.mapInArrow(count, "doc_id long, source string, lang string, n_tokens long")
    return counted.where("n_tokens > 0")


def pour(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """Split a budget by weights; what a capped share cannot take goes to the others by their weights."""
    got = [0.0] * len(weights)
    open_ = [i for i, (w, c) in enumerate(zip(weights, caps, strict=True)) if w > 0 and c > 0]
    left = budget
    while open_ and left > 1e-9 * max(budget, 1):
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if got[i] + left * weights[i] / total >= caps[i]]
        if not full:
            for i in open_:
                got[i] += left * weights[i] / total
            break
        for i in full:
            left -= caps[i] - got[i]
            got[i] = caps[i]
        open_ = [i for i in open_ if i not in full]
    return got


def budgets(weights: dict[tuple[str, str, str], float], caps: dict[tuple[str, str, str], float], total: float) -> dict[tuple[str, str, str], float]:
    """Tokens of every leaf (domain, language, source), by pouring ``total`` down the tree."""

    def down(leaves: list[tuple[str, str, str]], depth: int, amount: float) -> dict:
        if depth == 3:
            return {leaves[0]: min(amount, caps.get(leaves[0], 0.0))}
        kids: dict[str, list] = defaultdict(list)
        for leaf in leaves:
            kids[leaf[depth]].append(leaf)
        names = sorted(kids)
        w = [sum(weights[x] for x in kids[k]) for k in names]
        c = [sum(caps.get(x, 0.0) for x in kids[k]) for k in names]
        out = {}
        for k, a in zip(names, pour(amount, w, c), strict=True):
            out |= down(kids[k], depth + 1, a)
        return out

    return down(sorted(weights), 0, total) if weights else {}


def full_total(weights: dict, caps: dict) -> float:
    """The largest total at which no leaf that has documents falls short."""
    shares = budgets(weights, {k: float("inf") if v > 0 else 0.0 for k, v in caps.items()}, 1.0)
    fits = [caps[k] / s for k, s in shares.items() if s > 0 and caps.get(k, 0) > 0]
    return min(fits, default=0.0)


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: int | None = None, whole: bool = False, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``targets``: ``source, target_share, max_repeats``; shares are taken relative to their sum, rows of null
    source or of no positive share are ignored, a null ``max_repeats`` is 1, repeated sources add up. Without
    ``total_tokens`` the mix is as large as it can be while no source with documents misses its share; with it, or
    with ``whole`` (as many tokens as the sources' documents hold together), shortages are redistributed among siblings
    and then among their ancestors' siblings. ``tokenizer`` is the path of a public vocabulary file. Documents of other sources, without id, or without a token are not used;
    repeated rows of a document count once. The mix: ``doc_id, source, lang, n_tokens, repeat_no`` (one row per
    use). The report: per target source ``target_share, actual_share, n_tokens, n_docs, max_uses``.
    """
    spark = documents.sparkSession
    goal = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("max_repeats"))
    goal = goal.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    goal = goal.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goals = {r[0]: (r[1], r[2]) for r in goal.limit(MAX_LEAVES + 1).collect()}
    if len(goals) > MAX_LEAVES:
        raise ValueError("too many target sources")
    counted = token_counts(documents, tokenizer).join(F.broadcast(goal.select("source")), "source", "left_semi")
    counted = cut_lineage(counted.dropDuplicates(["doc_id"]).select("doc_id", "source", "lang", "n_tokens"))
    have = {(r[0], r[1]): r[2] for r in counted.groupBy("source", "lang").agg(F.sum("n_tokens")).limit(MAX_LEAVES + 1).collect()}
    if len(have) > MAX_LEAVES:
        raise ValueError("too many languages")
    weight = sum(w for w, _ in goals.values()) or 1.0
    by_source: dict[str, int] = defaultdict(int)
    for (s, _), n in have.items():
        by_source[s] += n
    weights = {(domain_name(s), lang, s): goals[s][0] / weight * n / by_source[s] for (s, lang), n in have.items()}
    weights |= {(domain_name(s), "und", s): w / weight for s, (w, _) in goals.items() if s not in by_source}
    caps = {(domain_name(s), lang, s): float(n * goals[s][1]) for (s, lang), n in have.items()}
    total = float(sum(have.values())) if whole else full_total(weights, caps) if total_tokens is None else float(total_tokens)
    plan = []
    for (_, lang, s), amount in budgets(weights, caps, total).items():
        n = have.get((s, lang), 0)
        if n and amount > 0:
            epochs = min(int(amount / n + 1e-9), goals[s][1])
            plan.append((s, lang, epochs, float(amount - epochs * n) if epochs < goals[s][1] else 0.0))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, lang string, epochs int, rest double"))
    placed = counted.join(plan_df, ["source", "lang"])
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    placed = placed.withColumn("place", order).withColumn("range", F.pmod(order, F.lit(RANGES)).cast("int"))
    sums = placed.groupBy("source", "lang", "range", "rest").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy("source", "lang").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("n").over(running)).where("upto > rest")
    ends = ends.groupBy("source", "lang").agg(F.min("range").alias("last_range"), F.min_by(F.col("upto") - F.col("n"), "range").alias("before"))
    placed = placed.join(F.broadcast(ends), ["source", "lang"], "left")  # one row per leaf
    inside = Window.partitionBy("source", "lang", "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_end = placed.where("range = last_range").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("upto")
    others = placed.where("last_range IS NULL OR range <> last_range").withColumn("extra", F.when(F.col("last_range").isNull(), (F.col("rest") > 0).cast("int")).otherwise((F.col("range") < F.col("last_range")).cast("int")))
    used = others.unionByName(at_end).withColumn("uses", F.col("epochs") + F.col("extra")).where("uses > 0").select("doc_id", "source", "lang", "n_tokens", "uses")
    mix = used.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("uses")))).drop("uses")
    per_source = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("max_uses"))
    all_tokens = per_source.agg(F.sum("n_tokens").alias("all_tokens"))
    report = goal.join(F.broadcast(per_source), "source", "left").crossJoin(F.broadcast(all_tokens))
    report = report.select(
        "source",
        (F.col("target_share") / F.lit(weight)).alias("target_share"),
        F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_tokens", "n_docs", "max_uses")),
    )
    return mix, report
