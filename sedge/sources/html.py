"""HTML pages as ordered blocks, with scores of how well a page was read."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "pre": "code", "figcaption": "caption", "td": "cell", "th": "cell"}
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "form", "svg"}


class _Reader(HTMLParser):
    """Collects (kind, level, text); text outside of a known element is a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.kind, self.level, self.text, self.skip = [], "paragraph", 0, [], 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((self.kind, self.level, text))
        self.text, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in HEADINGS:
            self.flush()
            self.kind, self.level = "heading", HEADINGS[tag]
        elif tag in BLOCKS:
            self.flush()
            self.kind = BLOCKS[tag]
        elif tag in ("br", "tr", "div", "section", "article", "table", "ul", "ol"):
            self.text.append("\n") if tag == "br" else self.flush()

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in HEADINGS or tag in BLOCKS or tag in ("div", "section", "article", "table", "ul", "ol"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def read(html: str | None) -> list[tuple[str, int, str]]:
    r = _Reader()
    r.feed(html or "")
    r.close()
    r.flush()
    return r.out


def blocks(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> page_id, position, kind, level, text; paragraphs that repeat the one before are left out."""

    def run(parts):
        for pdf in parts:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                last, n = None, 0
                for kind, level, text in read(html):
                    if (kind, text) == last:
                        continue
                    last = (kind, text)
                    rows.append((page, n, kind, level, text))
                    n += 1
            yield pd.DataFrame(rows, columns=["page_id", "position", "kind", "level", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position long, kind string, level int, text string")


def quality(found: DataFrame) -> DataFrame:
    """Counts by kind, words, and whether a page holds an article (400 characters and two paragraphs)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    g = found.groupBy("page_id").agg(
        n("heading").alias("headings"), n("paragraph").alias("paragraphs"), n("list_item").alias("items"), n("cell").alias("cells"),
        F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", " "))).cast("long").alias("words"),
    )
    return g.withColumn("is_article", (F.col("chars") >= 400) & (F.col("paragraphs") >= 2))
