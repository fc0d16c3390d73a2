"""HTML pages: headings, links, sections and the words they mention."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Confidence of a mention by the element it stands in.
CONFIDENCE = {"heading": 0.90, "code": 0.80, "strong": 0.80, "em": 0.80, "text": 0.75, "a": 0.70, "script": 0.70, "td": 0.65, "th": 0.65}
_HEADINGS = {f"h{i}": i for i in range(1, 7)}


def heading_counts(pages: DataFrame) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<h([1-6])[\s>]"), 1)).alias("level")
    return pages.select("page_id", found).groupBy("page_id", F.col("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def links(pages: DataFrame) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a[^>]*href="([^"]*)"'), 1)).alias("target")
    return pages.select("page_id", found).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


class _Sections(HTMLParser):
    """Text after a heading belongs to the latest heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, "", ""]]
        self.open: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _HEADINGS:
            self.rows.append([_HEADINGS[tag], "", ""])
        self.skip += tag in ("script", "style")
        self.open.append(tag)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.skip:
            return
        self.rows[-1][1 if any(t in _HEADINGS for t in self.open) else 2] += data


def parse_sections(html: str | None) -> list[tuple[int, str, str]]:
    """(level, title, text) in order; level 0 is what comes before the first heading."""
    p = _Sections()
    p.feed(html or "")
    p.close()
    rows = [(level, " ".join(t.split()), " ".join(x.split())) for level, t, x in p.rows]
    return [r for r in rows if r[0] or r[2]]


def sections(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, section, level, title, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, level, title, len(text.split())) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (level, title, text) in enumerate(parse_sections(h))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "section", "level", "title", "n_words"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, section int, level int, title string, n_words long")
