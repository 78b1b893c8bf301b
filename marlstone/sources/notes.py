"""Block-structured notes (pages of nested JSON blocks) as Markdown, and their incremental listing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<plain_text:string,href:string,annotations:struct<code:boolean,bold:boolean,italic:boolean,strikethrough:boolean>>"
DEPTH = 10
UNTITLED = "Página sin título"


def rich_text(spans: Column) -> Column:
    """Spans of text as Markdown: code alone, else bold inside italic inside strike; a link around all. Native."""
    on = lambda s, name: F.coalesce(s["annotations"][name], F.lit(False))
    wrap = lambda c, mark, test: F.when(test, F.concat(F.lit(mark), c, F.lit(mark))).otherwise(c)

    def of(s: Column) -> Column:
        t = s["plain_text"]
        styled = wrap(wrap(wrap(t, "**", on(s, "bold")), "_", on(s, "italic")), "~~", on(s, "strikethrough"))
        t2 = F.when(on(s, "code"), F.concat(F.lit("`"), t, F.lit("`"))).otherwise(styled)
        linked = F.when(F.coalesce(s["href"], F.lit("")) != "", F.concat(F.lit("["), t2, F.lit("]("), s["href"], F.lit(")"))).otherwise(t2)
        return F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(linked)

    return F.coalesce(F.array_join(F.transform(spans, of), ""), F.lit(""))


def spans_to_markdown(spans: list[dict] | None) -> str:
    out = []
    for s in spans or ():
        t, a = s.get("plain_text") or "", s.get("annotations") or {}
        if t:
            marks = ["`"] if a.get("code") else [m for name, m in (("bold", "**"), ("italic", "_"), ("strikethrough", "~~")) if a.get(name)]
            for m in marks:
                t = f"{m}{t}{m}"
            out.append(f"[{t}]({s['href']})" if s.get("href") else t)
    return "".join(out)


def _table(block: dict) -> str:
    rows = [[spans_to_markdown(c).replace("|", "\\|") for c in (r.get("table_row") or {}).get("cells") or ()] for r in block.get("children") or () if r.get("type") == "table_row"]
    if not rows:
        return ""
    width = max(1, *map(len, rows))
    line = lambda r: f"| {' | '.join([*r, *[''] * (width - len(r))])} |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


#: Lines of a block by type, from its text, content and indentation; types that are not here keep their text.
_Lines = Callable[[str, dict, str], list[str]]
_caption: _Lines = lambda t, c, i: [f"_{x}_", ""] if (x := spans_to_markdown(c.get("caption"))) else []
_child: _Lines = lambda t, c, i: [f"- {c['title']}"] if c.get("title") else []
_nothing: _Lines = lambda t, c, i: []
_quote: _Lines = lambda t, c, i: [f"> {t}", ""]
LINES: dict[str, _Lines] = {
    **{f"heading_{n}": (lambda t, c, i, n=n: ["", f"{'#' * n} {t}", ""]) for n in (1, 2, 3)},
    "bulleted_list_item": lambda t, c, i: [f"{i}- {t}"],
    "to_do": lambda t, c, i: [f"{i}- [{'x' if c.get('checked') is True else ' '}] {t}"],
    "quote": _quote,
    "callout": _quote,
    "code": lambda t, c, i: ["```" + (c.get("language") or ""), t, "```", ""],
    "divider": lambda t, c, i: ["---", ""],
    "toggle": lambda t, c, i: [f"**{t}**", ""] if t else [],
    **dict.fromkeys(("child_page", "child_database"), _child),
    **dict.fromkeys(("image", "video", "file", "pdf"), _caption),
    **dict.fromkeys(("table_of_contents", "breadcrumb", "column_list", "column", "table_row"), _nothing),
}
_plain: _Lines = lambda t, c, i: [t, ""] if t else []
_INDENTED = ("bulleted_list_item", "numbered_list_item", "to_do")


def blocks_to_markdown(blocks: list[dict], depth: int = 0) -> str:
    import re

    if depth > DEPTH:
        return ""
    lines: list[str] = []
    number = 0
    for b in blocks:
        kind, indent = b.get("type", ""), "  " * depth
        content = b.get(kind) or {}
        text = spans_to_markdown(content.get("rich_text"))
        number = number + 1 if kind == "numbered_list_item" else 0
        if number:
            lines.append(f"{indent}{number}. {text}")
        elif kind == "table":
            lines += [_table(b), ""]
        else:
            lines += LINES.get(kind, _plain)(text, content, indent)
        inside = [x for x in b.get("children") or () if kind != "table" or x.get("type") != "table_row"]
        nested = blocks_to_markdown(inside, depth + (kind in _INDENTED)) if inside else ""
        if nested.strip():
            lines.append(nested)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def page_title(properties: Column) -> Column:
    """properties: map of name to struct(type, title: array of spans). The first title with text."""
    own = F.filter(F.map_values(properties), lambda p: (p["type"] == "title") & (F.array_join(F.transform(p["title"], lambda s: s["plain_text"]), "") != ""))
    return F.coalesce(F.array_join(F.transform(F.get(own, F.lit(0))["title"], lambda s: s["plain_text"]), ""), F.lit(UNTITLED))


def changed(listing: DataFrame, seen: DataFrame, key: str = "page_id", mark: str = "last_edited_time") -> DataFrame:
    """Rows of a listing that are not archived and not in seen with the same mark."""
    live = listing.where(~F.coalesce("archived", F.lit(False)) & ~F.coalesce("in_trash", F.lit(False)))
    return live.join(seen.select(key, mark), [key, mark], "left_anti")


def to_markdown(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, markdown: title and content of each page. pages: key, title, blocks (JSON array). Empty pages have no row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [blocks_to_markdown(json.loads(b or "[]")) for b in batch.column(2).to_pylist()]
            said = [f"# {t}\n\n{m}" if m else None for t, m in zip(batch.column(1).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], [key, "markdown"])

    at = pages.select(key, "title", "blocks")
    return at.mapInArrow(of, at.select(key).schema.add("markdown", "string")).where("markdown is not null")
