"""Sources by kind, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marlstone.sources import files, notes, web

#: kind: function of a listing and what was seen, giving what changed
SOURCES: dict[str, Callable[..., DataFrame]] = {"URL": web.crawl, "SITEMAP": web.crawl, "NOTION": notes.changed, "GOOGLE_DRIVE": files.drive_listing}


def register_source(kind: str, function: Callable[..., DataFrame]) -> None:
    SOURCES[kind] = function


def source_for(kind: str) -> Callable[..., DataFrame]:
    if kind not in SOURCES:
        raise web.ConnectorError(f"no source of kind {kind!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[kind]
