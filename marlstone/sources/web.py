"""A crawl over a table of fetched pages, and the parts of a crawler.

The site is a table (url, html, status, content_type), fetched elsewhere; the
crawl is a breadth-first search in DataFrames, one join for each depth. A page
is discovered if its hash differs from the one in the cursor table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.tables import written

USER_AGENT = "marlstone-crawler/1.0"
MAX_PAGE_BYTES = 5 * 1024 * 1024


class ConnectorError(ValueError):
    """permanent: trying again will not help."""

    def __init__(self, message: str, permanent: bool = True):
        super().__init__(message)
        self.permanent = permanent


def clamp(value: float | None, default: int, low: int, high: int) -> int:
    value = default if value is None else value
    if value != value or value in (float("inf"), float("-inf")):
        return low
    return min(high, max(low, int(value)))


@dataclass(frozen=True)
class WebConfig:
    start_urls: tuple[str, ...]
    max_pages: int = 100
    max_depth: int = 3
    delay_ms: int = 500
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    respect_robots: bool = True

    @staticmethod
    def of(raw: dict) -> WebConfig:
        urls = raw.get("startUrls")
        if not isinstance(urls, list) or not urls or len(urls) > 20:
            raise ConnectorError("a web source has 1 to 20 start URLs")
        for u in urls:
            if not isinstance(u, str) or urlsplit(u).scheme not in ("http", "https") or not urlsplit(u).netloc:
                raise ConnectorError(f"not a start URL: {u!r}")
        patterns = [tuple(raw.get(k) or ()) for k in ("includePatterns", "excludePatterns")]
        for p in (x for own in patterns for x in own):
            try:
                re.compile(p)
            except re.error as error:
                raise ConnectorError(f"not a pattern: {p!r}") from error
        return WebConfig(tuple(urls), clamp(raw.get("maxPages"), 100, 1, 2000), clamp(raw.get("maxDepth"), 3, 0, 10), clamp(raw.get("delayMs"), 500, 0, 30000), *patterns, raw.get("respectRobots", True))


@dataclass(frozen=True)
class ListConfig:
    """A source that lists documents behind a credential: notes, or a drive with its folders."""

    credential: str
    most: int = 500
    folders: tuple[str, ...] = ()

    @staticmethod
    def of(raw: dict, credential: str, most: str) -> ListConfig:
        """credential and most: the names of these settings."""
        secret, folders = raw.get(credential), raw.get("folderIds") or []
        if not isinstance(secret, str) or not secret.strip():
            raise ConnectorError(f"{credential} is missing")
        if not isinstance(folders, list) or not all(isinstance(f, str) for f in folders):
            raise ConnectorError("folderIds are texts")
        return ListConfig(secret, clamp(raw.get(most), 500, 1, 5000), tuple(folders))


#: Settings of sources by kind.
CONFIGS = {
    "URL": WebConfig.of,
    "SITEMAP": WebConfig.of,
    "NOTION": lambda raw: ListConfig.of(raw, "token", "maxPages"),
    "GOOGLE_DRIVE": lambda raw: ListConfig.of(raw, "serviceAccount", "maxFiles"),
}


def canonical(url: str) -> str:
    """Lower scheme and host, no default port, no fragment, a path at least."""
    p = urlsplit(url)
    host = (p.hostname or "").lower()
    port = f":{p.port}" if p.port and p.port != {"http": 80, "https": 443}.get(p.scheme.lower()) else ""
    return f"{p.scheme.lower()}://{host}{port}{p.path or '/'}{'?' + p.query if p.query else ''}"


#: Schemes of links that lead to no page.
OTHER_SCHEMES = ("mailto", "tel", "javascript", "data")


def hrefs(html: Column) -> Column:
    """Targets of links as they are written, in order, without other schemes."""
    quoted = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*("[^"]+"|'[^']+')"""), F.lit(1))
    found = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    return F.filter(found, lambda h: ~F.lower(F.trim(F.substring_index(h, ":", 1))).isin(*OTHER_SCHEMES) | ~F.contains(h, F.lit(":")))


def title(html: Column) -> Column:
    """The first title; null if there is none or a blank one."""
    return F.nullif(tx.collapse(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)), F.lit(""))


def language(html: Column) -> Column:
    """Two letters of the page's language; null if it names none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html(?:\s[^>]*?)?\slang\s*=\s*["']?([a-z]{2})""", 1)), F.lit(""))


def sitemap(xml: Column) -> Column:
    """Locations of a sitemap or of an index of sitemaps."""
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>([^<]*)</loc>"), F.lit(1)), tx.trim), lambda x: x != "")


def parse_robots(text: str, agent: str = USER_AGENT) -> list[str]:
    """Path prefixes that everyone, or agent, is kept from."""
    out, ours = [], False
    for line in text.splitlines():
        key, colon, value = line.split("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            ours = value == "*" or value.lower() in agent.lower()
        elif key == "disallow" and colon and ours and value:
            out.append(value)
    return out


def allowed(path: Column, rules: Column) -> Column:
    """rules: array of prefixes; null if there is no robots.txt."""
    return ~F.coalesce(F.exists(rules, lambda r: F.startswith(path, r)), F.lit(False))


def matches_patterns(url: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    any_of = lambda patterns: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(url, p))
    kept = any_of(include) if include else F.lit(True)
    return kept & ~any_of(exclude) if exclude else kept


def placed_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url, place, link: absolute, canonical links of each page, each once, with the number of the first target that names it."""
    at = pages.select(F.col(url_col).alias("url"), hrefs(F.col(html_col)).alias("hrefs")).where(F.size("hrefs") > 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[str, int] = {}
                for k, h in enumerate(found):
                    try:
                        u = urljoin(base, h.strip())
                        if urlsplit(u).scheme in ("http", "https"):
                            own.setdefault(canonical(u), k)
                    except ValueError:
                        continue
                rows += [(base, k, u) for u, k in own.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["url", "place", "link"])

    return at.mapInArrow(of, "url string, place int, link string")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url, position, link: absolute, canonical links of each URL, each once, in order.

    Several pages of one URL have one list: a link stands where the first of them
    names it, and of links with one place the lesser comes first.
    """
    own = placed_links(pages, url_col, html_col).repartition("url").groupBy("url", "link").agg(F.min("place").alias("place"))
    return own.select("url", (F.row_number().over(Window.partitionBy("url").orderBy("place", "link")) - 1).alias("position"), "link")


def sitemap_pages(sitemaps: DataFrame, depth: int = 2) -> DataFrame:
    """url: pages that the start documents (is_start) name. sitemaps: url, xml, is_start. An index names sitemaps, which are read, too."""
    named = written(sitemaps.select("url", "is_start", F.explode(sitemap(F.col("xml"))).alias("loc")), "sitemap-entries")
    inner = sitemaps.select(F.col("url").alias("loc")).distinct()
    level = named.where("is_start").select("loc").distinct()
    out = level.join(inner, "loc", "left_anti")
    for _ in range(depth - 1):
        level = written(named.join(level.join(inner, "loc", "left_semi").withColumnRenamed("loc", "url"), "url", "left_semi").select("loc").distinct(), "sitemap-level")
        out = out.unionByName(level.join(inner, "loc", "left_anti"))
    return out.distinct().withColumnRenamed("loc", "url")


def crawl(pages: DataFrame, config: WebConfig, seen: DataFrame, robots: DataFrame | None = None, sitemaps: DataFrame | None = None) -> DataFrame:
    """url, depth, checksum, title, state (discovered or unchanged) of the pages that are reached.

    pages: url (canonical), html; seen: url, checksum of the last crawl; robots:
    origin, rules; sitemaps: as sitemap_pages() takes them, whose pages are starts,
    too. Pages that did not change are still read for links. max_pages counts what
    is reached, nearest first, by URL within a depth.
    """
    spark = pages.sparkSession
    origins = sorted({"{0.scheme}://{0.netloc}".format(urlsplit(canonical(u))) for u in config.start_urls})
    origin = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    own = pages.where(origin.isin(*origins)).where(matches_patterns(F.col("url"), config.include, config.exclude))
    if config.respect_robots and robots is not None:
        path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), r"\?.*$", "")
        own = own.withColumn("origin", origin).join(F.broadcast(robots.where(F.col("origin").isin(*origins))), "origin", "left").where(allowed(path, F.col("rules"))).drop("origin", "rules")
    edges = written(placed_links(own).select("url", "link"), "crawl-links")
    starts = spark.createDataFrame([(canonical(u),) for u in config.start_urls], "url string")
    starts = starts if sitemaps is None else starts.unionByName(sitemap_pages(sitemaps))
    reached = written(starts.distinct().join(own.select("url"), "url", "left_semi").withColumn("depth", F.lit(0)), "crawl-reached")
    frontier = reached
    for depth in range(1, config.max_depth + 1):
        found = edges.join(frontier.select("url"), "url").select(F.col("link").alias("url")).distinct()
        # written, as each depth would otherwise repeat the plans of all before it
        frontier = written(found.join(own.select("url"), "url", "left_semi").join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "crawl-frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    near = reached.orderBy("depth", "url").limit(config.max_pages)
    at = near.join(own, "url").withColumn("checksum", F.sha2("html", 256)).join(seen.select("url", F.col("checksum").alias("known")), "url", "left")
    return at.select("url", "depth", "checksum", title(F.col("html")).alias("title"), F.when(F.col("checksum").eqNullSafe(F.col("known")), "unchanged").otherwise("discovered").alias("state"))
