"""Stored web and wiki pages as documents, and the links on them."""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.slices import slices
from corpusflow.session import materialized

_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_BLOCKS = {"p", "div", "article", "section", "main", "header", "footer", "nav", "aside", "ul", "ol", "li", "table", "tr",
           "blockquote", "pre", "figure", "form", "dl", "dt", "dd", "body", "title", "hr", *_HEADINGS}
_READ = pa.schema([("source", pa.string()), ("ord", pa.int32()), ("page_content", pa.string()), ("category", pa.string()), ("error", pa.string())])
_HIDDEN = {"script", "style", "head", "noscript", "template"}


class _Elements(HTMLParser):
    """Collects ``(category, text)`` of the block elements of a page.

    With ``marks`` the text keeps headings, list items and links in plain-text notation.
    """

    def __init__(self, marks: bool):
        super().__init__(convert_charrefs=True)
        self.marks = marks
        self.found: list[tuple[str, str]] = []
        self.words: list[str] = []
        self.open: list[str] = []
        self.hidden = 0
        self.links: list[str | None] = []
        self.counters: list[int | None] = []

    def flush(self, tag: str | None = None) -> None:
        text = re.sub(r"[ \t\r\n\f]+", " ", "".join(self.words)).strip()
        self.words = []
        if not text:
            return
        tag = next((t for t in reversed(self.open) if t in _HEADINGS or t in ("li", "table")), "p")
        category = "Title" if tag in _HEADINGS else "ListItem" if tag == "li" else "Table" if tag == "table" else "NarrativeText"
        if self.marks:
            if tag in _HEADINGS:
                text = "#" * _HEADINGS[tag] + " " + text
            elif tag == "li":
                depth = max(1, len(self.counters))
                count = self.counters[-1] if self.counters else None
                text = "  " * depth + ("* " if count is None else f"{count}. ") + text
        self.found.append((category, text))

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.flush()
            self.hidden += 1
        elif tag == "body":
            self.hidden = 0  # an unclosed head must not hide the page
        if tag in _BLOCKS:
            self.flush()
            if tag in ("ul", "ol"):
                self.counters.append(0 if tag == "ol" else None)
            if tag == "li" and self.counters and self.counters[-1] is not None:
                self.counters[-1] += 1
            if tag != "hr":
                self.open.append(tag)
        elif tag == "br":
            self.words.append(" ")
        elif tag in ("td", "th"):
            self.words.append(" ")
        elif tag == "a" and self.marks and not self.hidden:
            href = dict(attrs).get("href")
            self.links.append(href)
            if href:
                self.words.append("[")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.flush()
            if tag in ("ul", "ol") and self.counters:
                self.counters.pop()
            if tag in self.open:
                while self.open.pop() != tag:
                    pass
        elif tag == "a" and self.marks and self.links:
            href = self.links.pop()
            if href:
                self.words.append(f"]({href})")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def _elements(html: str, marks: bool = False) -> list[tuple[str, str]]:
    parser = _Elements(marks)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def _plain(markup: str) -> str:
    """Markdown, HTML or both as plain text: links stay, pictures and emphasis go."""
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", markup)
    if "<" not in text:
        text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
        text = re.sub(r"(?<![\w*])([*_])(?=\S)([^*_\n]+?)(?<=\S)\1(?![\w*])", r"\2", text)
        text = re.sub(r"(?m)^[ ]{0,3}[-*+] +", "  * ", text)
        return text.replace("\\", "")
    lines: list[str] = []
    last = ""
    for category, piece in _elements(text, marks=True):
        if lines and not (category == last == "ListItem"):
            lines.append("")
        lines.append(piece)
        last = category
    return "\n".join(lines).replace("\\", "")


def markup_to_text(df: DataFrame, col: str, out: str = "text") -> DataFrame:
    """Replace markup column ``col`` by plain text ``out``, row by row in Arrow batches."""
    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(_plain, na_action="ignore")

    return df.withColumn(out, plain(F.col(col)))


def _read_pages(pages: DataFrame, mode: str, url_col: str, html_col: str) -> DataFrame:
    """``(source, ord, page_content, category, error)``: the elements of pages, or why there are none."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in slices(batch.column(1)):
                rows = []
                for url, html in zip(*(batch.column(i).slice(first, n).to_pylist() for i in (0, 1))):
                    try:
                        if html is None:
                            raise LookupError("no page is stored")
                        found = _elements(html)
                    except Exception as error:  # a broken page must not stop the others
                        rows.append((url, 0, None, None, f"{type(error).__name__}: {error}"))
                        continue
                    if mode == "single":
                        rows.append((url, 0, "\n\n".join(t for _, t in found), None, None))
                    else:
                        rows.extend((url, i, t, c, None) for i, (c, t) in enumerate(found))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, _READ)], schema=_READ)

    return pages.select(url_col, html_col).mapInArrow(read, "source string, ord int, page_content string, category string, error string")


def _documents(parsed: DataFrame, mode: str) -> DataFrame:
    meta = F.create_map(F.lit("source"), F.col("source"))
    if mode != "single":
        meta = F.map_concat(meta, F.create_map(F.lit("category"), F.col("category")))
    return parsed.select("source", "ord", "page_content", meta.alias("metadata"))


def pages_to_documents(pages: DataFrame, on_error: str = "skip", mode: str = "single", *,
                       url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Documents of stored pages.

    ``single``: one document per page, its elements separated by blank lines. ``elements``:
    one per element, with its category. A page that cannot be read is left out, or fails the
    job with ``on_error="raise"``; ``load_pages`` tells which they are.
    """
    parsed = _read_pages(pages, mode, url_col, html_col)
    if on_error == "raise":
        failed = F.raise_error(F.concat(F.lit("cannot read "), "source", F.lit(": "), "error")).cast("string")
        parsed = parsed.withColumn("page_content", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("page_content")))
    else:
        parsed = parsed.where(F.col("error").isNull())
    return _documents(parsed, mode)


def load_pages(pages: DataFrame, mode: str = "single", *, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """``(documents, errors)``: pages are read once into a scratch table that both are taken from.

    ``errors``: address and cause of each page that could not be read, be it broken or never stored.
    """
    parsed = materialized(_read_pages(pages, mode, url_col, html_col), "pages")
    return _documents(parsed.where(F.col("error").isNull()), mode), parsed.where(F.col("error").isNotNull()).select("source", "error")


def wiki_documents(pages: DataFrame, space: str | None = None, *, space_col: str = "space", body_col: str = "html",
                   attachment_col: str | None = None) -> DataFrame:
    """Pages of one wiki space (or of all), without attachments, as plain text."""
    if space is not None:
        pages = pages.where(F.col(space_col) == space)
    if attachment_col is not None:
        pages = pages.where(~F.col(attachment_col))
    return markup_to_text(pages, body_col, "page_content")


def links_of(html: Column) -> Column:
    """Array of the ``href`` values of all anchors outside comments and scripts."""
    seen = F.regexp_replace(html, r"(?is)<!--.*?-->|<script.*?</script>", "")
    found = F.regexp_extract_all(seen, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))


def page_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per anchor: the page's other columns and ``href``."""
    return pages.withColumn("href", F.explode(links_of(F.col(html_col)))).drop(html_col)

