"""Wiki REST source as a Spark data source: pages by id, child listings, with retries.

``spark.read.format("wiki_pages")`` reads the pages of the ids in option ``ids`` (comma-separated), spread over
``partitions`` partitions; ``format("wiki_children")`` the child edges of those pages.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Observation, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers after which a request is tried again with a pause.
BUSY = {429, 502, 503, 504}


def fetch_json(url: str, token: str = "anonymous", tries: int = 4, backoff: float = 1.5, timeout: float = 40.0, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """The JSON at an address, or None after the last try.

    Busy answers and network errors wait longer with each try; any other failed answer is tried again at once.
    """
    headers = {"Accept": "application/json"} | ({} if token in ("", "anonymous") else {"Authorization": f"Bearer {token}"})
    for i in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as got:
                return json.load(got)
        except urllib.error.HTTPError as e:
            if e.code in BUSY:
                sleep(backoff * (i + 1))
        except (OSError, ValueError):
            sleep(backoff * (i + 1))
    return None


def home_page_id(base: str, space: str, **how) -> str:
    """Id of a space's home page; an unreachable space is an error."""
    got = fetch_json(f"{base}/rest/api/space/{urllib.parse.quote(space)}?expand=homepage", **how)
    if not got or not (got.get("homepage") or {}).get("id"):
        raise RuntimeError(f"the home page of space {space} cannot be read")
    return str(got["homepage"]["id"])


def child_ids(base: str, page_id: str, size: int = 200, **how) -> Iterator[str]:
    """Ids of a page's children over all result pages; the listing ends where a request fails."""
    url: str | None = f"{base}/rest/api/content/{page_id}/child/page?limit={size}"
    while url:
        got = fetch_json(url, **how)
        if not got:
            return
        for row in got.get("results", []):
            if row.get("id") is not None:
                yield str(row["id"])
        following = (got.get("_links") or {}).get("next")
        url = urllib.parse.urljoin(base + "/", following) if following else None


def page_row(base: str, space: str, page_id: str, got: dict) -> tuple:
    """The fields of a page, with defaults for those that the answer lacks."""
    title = got.get("title", f"Untitled-{page_id}")
    version = got.get("version") or {}
    body = got["body"]["storage"].get("value", "") if "body" in got else ""
    url = f"{base}/spaces/{space}/pages/{page_id}/{(title or '').replace(' ', '+')}"
    return (page_id, space, title, "current", url, version.get("when"), int(version.get("number", 1)), body)


class _Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict, children: bool):
        self.base = options.get("base", "").rstrip("/")
        self.space = options.get("space", "")
        self.ids = [i.strip() for i in options.get("ids", "").split(",") if i.strip()]
        self.parts = max(1, int(options.get("partitions", "8")))
        self.how = {"token": options.get("token", "anonymous"), "tries": int(options.get("tries", "4")), "backoff": float(options.get("backoff", "1.5")), "timeout": float(options.get("timeout", "40"))}
        self.size = int(options.get("size", "200"))
        self.children = children

    def partitions(self) -> list[InputPartition]:
        n = min(self.parts, max(1, len(self.ids)))
        return [_Ids(self.ids[k::n]) for k in range(n)]

    def read(self, partition: _Ids) -> Iterator[tuple]:
        for page_id in partition.ids:
            if self.children:
                for child in child_ids(self.base, page_id, self.size, **self.how):
                    yield (page_id, child, "child")
            else:
                got = fetch_json(f"{self.base}/rest/api/content/{page_id}?expand=body.storage,version", **self.how)
                if got is not None:
                    yield page_row(self.base, self.space, page_id, got)


class WikiPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return "page_id string, space_key string, title string, status string, url string, last_updated string, version int, content_html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, children=False)


class WikiChildren(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki_children"

    def schema(self) -> str:
        return "src string, dst string, kind string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, children=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WikiPages)
    spark.dataSource.register(WikiChildren)


def crawl(spark: SparkSession, base: str | None = None, space: str | None = None, root: str | None = None, max_pages: int | None = None, stats: dict | None = None, **options: str):
    """Fetch a wiki level by level from its home page: (pages, attempted ids).

    Each level is one distributed read of its pages and one of their children; a page that cannot be fetched takes
    one of the ``max_pages`` attempts and contributes no edges. Only ids of the frontier, which ``max_pages``
    bounds, pass through the driver. Base, space and bound that are not given are those of the settings. ``stats`` is
    filled with the pages fetched, the ids attempted and the seconds taken.
    """
    from pyspark.sql import functions as F

    from lodestack.operators.html import parse_pages
    from lodestack.functions.text import url_to_id
    from lodestack.runtime import cut_lineage

    from lodestack.config import settings

    conf, began = settings(), time.monotonic()
    base, space, max_pages = base or conf.wiki_base, space or conf.wiki_space, conf.max_pages if max_pages is None else max_pages
    options = {"token": conf.wiki_token, "tries": str(conf.tries), "backoff": str(conf.backoff_s), "timeout": str(conf.timeout_s), "size": str(conf.list_size)} | options
    register(spark)
    base = base.rstrip("/")
    n_pages = 0
    how = {k: v for k, v in {"token": options.get("token"), "tries": int(options["tries"]) if "tries" in options else None, "backoff": float(options["backoff"]) if "backoff" in options else None}.items() if v is not None}
    level = [root or home_page_id(base, space, **how)]
    seen: dict[str, None] = dict.fromkeys(level)
    pages, attempted = None, []
    while level:
        level = level[: max_pages - len(attempted)]
        if not level:
            break
        attempted += level
        opts = {"base": base, "space": space, "ids": ",".join(level), **{k: str(v) for k, v in options.items()}}
        fetched = Observation()
        got = cut_lineage(spark.read.format("wiki_pages").options(**opts).load().observe(fetched, F.count(F.lit(1)).alias("n")))
        n_pages += fetched.get.get("n", 0)
        children = spark.read.format("wiki_children").options(**opts).load().join(got.select(F.col("page_id").alias("src")), "src", "left_semi").select("dst")
        linked = parse_pages(got, base=base).select(F.explode("links").alias("u")).select(url_to_id(F.col("u")).alias("dst"))
        found = children.unionByName(linked).where("dst IS NOT NULL").distinct().orderBy("dst")
        pages = got if pages is None else pages.unionByName(got)
        level = [r[0] for r in found.limit(max_pages + len(seen)).collect() if r[0] not in seen]
        seen |= dict.fromkeys(level)
    if stats is not None:
        stats |= {"pages": n_pages, "attempted": len(attempted), "seconds": time.monotonic() - began}
    return pages, attempted
