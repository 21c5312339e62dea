"""Scalar functions of the pipeline as column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: namespace of the deterministic chunk ids.
CHUNK_NAMESPACE = "1b671a64-40d5-491e-99b0-da01ff1f3341"


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode whitespace at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def url_to_id(url: Column) -> Column:
    """Page id of an address: the ``pageId`` parameter, else the number after ``/pages/``, else null."""
    return F.coalesce(_or_null(F.regexp_extract(url, r"pageId=(\d+)", 1)), _or_null(F.regexp_extract(url, r"/pages/(\d+)", 1)))


def base_url(c: Column) -> Column:
    """Base address without trailing slashes."""
    return F.regexp_replace(c, "/+$", "")


def page_url(base: Column, space: Column, page_id: Column, title: Column) -> Column:
    return F.concat(base, F.lit("/spaces/"), space, F.lit("/pages/"), page_id.cast("string"), F.lit("/"), F.replace(title, F.lit(" "), F.lit("+")))


def absolute_link(href: Column, base: str) -> Column:
    """A stripped address; one that starts with a slash gets the base in front."""
    h = strip(href)
    return F.when(h.startswith("/"), F.concat(F.lit(base), h)).otherwise(h)


def is_page_link(url: Column, base: str) -> Column:
    return url.startswith(base) & (url.contains("pageId=") | url.contains("/pages/"))


def has_table(text: Column) -> Column:
    """Whether a text shows a table: a bar before a blank or before a dash."""
    return F.coalesce(text.contains("| ") | text.contains("|-"), F.lit(False))


def linked_ids(ids: Column, most: int = 10) -> Column:
    """The first ``most`` ids as texts; null counts as none."""
    return F.slice(F.coalesce(ids.cast("array<string>"), F.array().cast("array<string>")), 1, most)


def rows_text(rows: Column) -> Column:
    """Table rows as lines of cells joined by `` | ``."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | ")), "\n")


def blocks_text(blocks: Column) -> Column:
    """Plain text of blocks, in order, one block a line (a table several); null blocks give the empty text."""
    line = lambda b: F.when(b["type"] == "table", rows_text(F.coalesce(b["rows"], F.array().cast("array<array<string>>")))).otherwise(F.coalesce(b["text"], F.lit("")))
    kept = F.filter(blocks, lambda b: b["type"].isin("text", "header", "table"))
    return F.coalesce(strip(F.array_join(F.transform(kept, line), "\n")), F.lit(""))


def role_line(role: Column, content: Column) -> Column:
    """``Role: content``; a null content is empty."""
    return F.concat(title_case(role), F.lit(": "), F.coalesce(content, F.lit("")))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, whatever stands before it: ``system_user`` is ``System_User``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def cache_key(query: Column, limit: Column, use_mmr: Column) -> Column:
    return F.md5(F.concat_ws(":", query, limit.cast("string"), F.when(use_mmr, "True").otherwise("False")).cast("binary"))


def uuid5(name: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a text; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(page_id: Column, parent_index: Column, child_index: Column) -> Column:
    return uuid5(F.concat_ws("_", page_id.cast("string"), parent_index.cast("string"), child_index.cast("string")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of one length; 0 where either is all zero; null for null."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot / n)


def or_default(c: Column, default: Column) -> Column:
    """``default`` for null and for the empty text."""
    return F.coalesce(_or_null(c), default)


def context_entry(title: Column, url: Column, chunk: Column) -> Column:
    """One source of a prompt's context; missing parts are written out as None."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(F.lit("Source: ["), none(title), F.lit("]("), none(url), F.lit(")\n"), none(chunk), F.lit("\n\n"))


def fill_template(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled; the values themselves are not read again."""
    import re

    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
        if piece:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")) if name in values else F.lit(piece))
    return F.concat(*parts)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, the terms of the sparse index; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)), F.array().cast("array<string>"))
