"""References to records that do not exist: skew-aware orphan detection.

References are pre-aggregated per key and period, and the counts are judged. Keys that hold more than ``heavy_share``
of all references are heavy; there are at most ``1 / heavy_share`` of them, so their states have a proven size and are
broadcast. The counts of all other keys go through one shuffle join. Both parts are united: as counts in the report,
and as references, looked up again by their counts, where the references themselves are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import cut_lineage

HEAVY_SHARE = 0.001

#: Fixed values of the wiki: base address of internal links.
WIKI_BASE = "https://wiki.quillmere.example"


def clean_id(c: Column) -> Column:
    """Id without surrounding whitespace and leading zeros; null where anything but digits is left."""
    bare = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    digits = F.when(bare.rlike(r"^[0-9]+$"), bare)
    return F.coalesce(F.nullif(F.regexp_replace(digits, r"^0+", ""), F.lit("")), F.when(digits.isNotNull(), F.lit("0")))


def link_target(address: Column, base: str = WIKI_BASE) -> Column:
    """Page id an internal address points to, null for any other address."""
    a = F.regexp_replace(address, r"(?U)^\s+|\s+$", "")
    a = F.when(a.startswith("/"), F.concat(F.lit(base), a)).otherwise(a)
    by_param = F.nullif(F.regexp_extract(a, r"pageId=([0-9]+)", 1), F.lit(""))
    by_path = F.nullif(F.regexp_extract(a, r"/pages/([0-9]+)", 1), F.lit(""))
    return F.when(a.startswith(base), clean_id(F.coalesce(by_param, by_path)))


def sync_time(c: Column) -> Column:
    """Timestamp of a text in any of the notations of ``synced_at``: UTC unless it states an offset."""
    t = F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2}) ", "$1T")
    return F.try_to_timestamp(F.when(t.rlike(r"T.*(?:Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.when(t.contains("T"), F.lit("Z")).otherwise(F.lit("T00:00:00Z")))))


def page_states(pages: DataFrame) -> DataFrame:
    """One row per page: ``target_page_id``, ``removed`` (by the current row's status), ``first_synced``.

    The current row is the one of the highest version; among equal versions a removed one counts.
    """
    status = F.lower(F.trim(F.col("status")))
    p = pages.select(
        clean_id(F.col("page_id")).alias("target_page_id"),
        F.col("version").alias("v"),
        F.coalesce(status.rlike(r"^(trashed|deleted)$"), F.lit(False)).alias("gone"),
        sync_time(F.col("synced_at")).alias("at"),
    ).where(F.col("target_page_id").isNotNull())
    return p.groupBy("target_page_id").agg(
        F.max(F.struct(F.coalesce(F.col("v"), F.lit(-1)), F.col("gone")))["gone"].alias("removed"), F.min("at").alias("first_synced")
    )


def distinct_references(refs: DataFrame) -> DataFrame:
    """Each reference once per key, target and month, with its earliest time in the month; null targets are left out.

    The grouping holds the record's own key, so no key of the targets is hot here.
    """
    month = F.date_format("ref_time", "yyyy-MM").alias("ref_month")
    return refs.where(F.col("target_page_id").isNotNull()).groupBy("ref_table", "ref_field", "ref_key", "target_page_id", month).agg(F.min("ref_time").alias("ref_time"))


def reference_counts(distinct: DataFrame) -> DataFrame:
    """References per table, field, target and month: ``n``, and the earliest and latest time. Combined before the shuffle."""
    return distinct.groupBy("ref_table", "ref_field", "target_page_id", "ref_month").agg(F.count("*").alias("n"), F.min("ref_time").alias("lo"), F.max("ref_time").alias("hi"))


def _reason(first, last):
    """Verdict on the references between two times: missing, deleted, late, or ``some`` where only a part of them is late."""
    return (
        F.when(F.col("removed").isNull(), F.lit("missing"))
        .when(F.col("removed"), F.lit("deleted"))
        .when(F.col("first_synced") > last, F.lit("late"))
        .when(F.col("first_synced") > first, F.lit("some"))
    )


def judged_counts(counts: DataFrame, states: DataFrame, heavy_share: float = HEAVY_SHARE) -> tuple[DataFrame, DataFrame]:
    """The counts of targets that are missing, removed or synced later, with the ``reason``: those of heavy targets, and the rest.

    A target is heavy that holds more than ``heavy_share`` of all references; there are at most ``1 / heavy_share``
    of them, so they and their states are broadcast. The counts of all others take one shuffle join.
    """
    per_key = counts.groupBy("target_page_id").agg(F.sum("n").alias("total_n"))
    total = counts.agg(F.sum("n").alias("total"))
    heavy = per_key.crossJoin(F.broadcast(total)).where(F.col("total_n") > F.col("total") * heavy_share).select("target_page_id")
    heavy_states = heavy.join(states, "target_page_id", "left").select("target_page_id", "removed", "first_synced", F.lit(True).alias("heavy"))
    marked = counts.join(F.broadcast(heavy_states), "target_page_id", "left")
    cols = [*counts.columns, "removed", "first_synced"]
    of_heavy = marked.where("heavy").select(*cols)
    rest = marked.where("heavy IS NULL").select(*counts.columns).join(states.hint("shuffle_hash"), "target_page_id", "left").select(*cols)
    reason = _reason(F.col("lo"), F.col("hi")).alias("reason")
    return tuple(part.select(*cols, reason).where(F.col("reason").isNotNull()) for part in (of_heavy, rest))


def _judge(refs: DataFrame, states: DataFrame, heavy_share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct references and judged counts of both kinds, each written once, as several branches read them."""
    filled = refs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("ref_table", "ref_field", "ref_key")), "target_page_id", "ref_time")
    distinct = cut_lineage(distinct_references(filled))
    of_heavy, rest = judged_counts(cut_lineage(reference_counts(distinct)), states, heavy_share)
    return distinct, cut_lineage(of_heavy), cut_lineage(rest)


def _expand(distinct: DataFrame, of_heavy: DataFrame, rest: DataFrame) -> DataFrame:
    """The references to judged targets: those to heavy ones by broadcast, the rest by one shuffle join."""

    def part(judged: DataFrame, heavy: bool) -> DataFrame:
        targets = judged.select("target_page_id", "removed", "first_synced").distinct()
        found = distinct.join(F.broadcast(targets) if heavy else targets.hint("merge"), "target_page_id")
        reason = _reason(F.col("ref_time"), F.col("ref_time")).alias("reason")
        return found.select("ref_table", "ref_field", "ref_key", "target_page_id", reason, "ref_month").where(F.col("reason").isNotNull())

    return part(of_heavy, True).unionByName(part(rest, False))


def orphan_references(refs: DataFrame, states: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """References whose target is missing, removed or synced only later.

    ``refs``: ``ref_table, ref_field, ref_key, target_page_id, ref_time`` (other columns are ignored); a null
    target is no reference, a null table, field or key counts as the empty text. ``states``: as of ``page_states``. Result: the first four columns, ``reason`` and
    ``ref_month`` (null where the time is), without repeated rows. A reference without time is never late.

    Counts per key and period are judged first; only the references behind a verdict are looked up again.
    """
    return _expand(*_judge(refs, states, heavy_share))


def orphan_report(refs: DataFrame, states: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Orphan references per table, field, reason and month: the united counts of heavy and other targets.

    Only months in which a page was first synced hold late and other references side by side; there the references
    themselves are counted.
    """
    distinct, of_heavy, rest = _judge(refs, states, heavy_share)
    cols = ["ref_table", "ref_field", "target_page_id", "ref_month"]
    judged = of_heavy.unionByName(rest)
    whole = judged.where("reason <> 'some'").select("ref_table", "ref_field", "reason", "ref_month", "n")
    some = _expand(distinct, *(v.where("reason = 'some'") for v in (of_heavy, rest))).where("reason = 'late'")
    counted = some.groupBy(*cols).agg(F.count("*").alias("n"))
    # a target may have whole months beside one of which a part is late
    part = counted.join(judged.where("reason = 'some'").select(*cols), cols, "left_semi").select("ref_table", "ref_field", F.lit("late").alias("reason"), "ref_month", "n")
    return whole.unionByName(part).groupBy("ref_table", "ref_field", "reason", "ref_month").agg(F.sum("n").alias("n_orphans"))


def wiki_references(pages: DataFrame, chunks: DataFrame, page_links: DataFrame, base: str = WIKI_BASE) -> DataFrame:
    """All references of the wiki's tables in the long form ``orphan_references`` takes."""
    page_key = F.concat(F.coalesce(F.col("page_id"), F.lit("")), F.lit(":"), F.coalesce(F.col("version").cast("string"), F.lit("")))

    def long(df: DataFrame, tab: str, field: str, key: Column, target: Column, at: Column) -> DataFrame:
        return df.select(F.lit(tab).alias("ref_table"), F.lit(field).alias("ref_field"), key.alias("ref_key"), target.alias("target_page_id"), at.alias("ref_time"))

    links = pages.select("page_id", "version", "synced_at", F.explode("internal_links").alias("link"))
    linked = chunks.select("id", "indexed_at", F.explode("linked_page_ids").alias("link"))
    return (
        long(links, "pages", "internal_links", page_key, link_target(F.col("link"), base), sync_time(F.col("synced_at")))
        .unionByName(long(linked, "chunks", "linked_page_ids", F.coalesce(F.col("id"), F.lit("")), clean_id(F.col("link")), F.col("indexed_at")))
        .unionByName(long(chunks, "chunks", "page_id", F.coalesce(F.col("id"), F.lit("")), clean_id(F.col("page_id")), F.col("indexed_at")))
        .unionByName(long(page_links, "page_links", "dst", F.coalesce(F.col("link_id").cast("string"), F.lit("")), clean_id(F.col("dst")), F.col("seen_at")))
    )
