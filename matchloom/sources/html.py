"""Tables of given HTML pages as rows; nothing is fetched."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

FIELDS = ["sr_no", "tender_ref_no", "title", "link", "duration"]
SHAPE = "page string, row_no int, sr_no string, tender_ref_no string, title string, link string, duration string"


class _Table(HTMLParser):
    """Cells of the body rows of the first table, with the first link of each cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.depth = self.tables = 0
        self.in_body = self.in_cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            self.depth += 1
        elif self.tables == 1 and self.depth == 1:
            if tag == "tbody":
                self.in_body = True
            elif tag == "tr" and self.in_body:
                self.rows.append([])
            elif tag == "td" and self.in_body and self.rows:
                self.rows[-1].append(["", None])
                self.in_cell = True
            elif tag == "a" and self.in_cell and self.rows[-1][-1][1] is None:
                self.rows[-1][-1][1] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag == "tbody" and self.depth == 1:
            self.in_body = False
        elif tag == "td":
            self.in_cell = False

    def handle_data(self, data):
        if self.in_cell and self.rows and self.rows[-1]:
            self.rows[-1][-1][0] += data


def rows_of(html: str | None) -> list[tuple[str, ...]]:
    """The rows with at least five cells and a link in the fourth; none for a page without table or body."""
    if not html:
        return []
    parser = _Table()
    parser.feed(html)
    parser.close()
    found = []
    for cells in parser.rows:
        if len(cells) >= len(FIELDS) and cells[3][1]:
            texts = [" ".join(c[0].split()) for c in cells]
            found.append((texts[0], texts[1], texts[2], cells[3][1], texts[4]))
    return found


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of the tables in ``pages(page, html)``."""

    def run(batches):
        for pdf in batches:
            rows = [(page, k, *row) for page, html in zip(pdf.page, pdf.html) for k, row in enumerate(rows_of(html))]
            yield pd.DataFrame(rows, columns=["page", "row_no", *FIELDS])

    return pages.select("page", "html").mapInPandas(run, SHAPE)
