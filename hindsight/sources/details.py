"""Detail pages: HTML tables as cells of a grid by a table function, and the typed rows of four layouts."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..plans.catalog import query
from .roles import MATCHES, matches

#: Spans beyond this are taken as this, so that a page can't make more cells than it has bytes for.
MOST_SPAN = 100


class _Reader(HTMLParser):
    """Collects (table, row, cells) of all tables of a page, nested ones as tables of their own; a cell is (header, rowspan, colspan, text parts)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[int] = []
        self.cell: dict[int, list | None] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif self.open and tag == "tr":
            self.tables[self.open[-1]].append([])
            self.cell[self.open[-1]] = None
        elif self.open and tag in ("td", "th"):
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            spans = dict(attrs)
            self.cell[self.open[-1]] = [tag == "th", self._span(spans.get("rowspan")), self._span(spans.get("colspan")), []]
            rows[-1].append(self.cell[self.open[-1]])

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self.cell[self.open[-1]] = None

    def handle_data(self, data: str) -> None:
        cell = self.cell.get(self.open[-1]) if self.open else None
        if cell is not None:
            cell[3].append(data)

    @staticmethod
    def _span(value: str | None) -> int:
        return min(max(int(value), 1), MOST_SPAN) if value and value.isascii() and value.isdigit() else 1


#: A tag in plain form, after its text.
_TAG = re.compile(r"""([^<]*)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][-a-zA-Z]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`/&]+))?)*)\s*>""")
_SPAN = re.compile(r"""\s([a-zA-Z][-a-zA-Z]*)(?:=(?:"([^"]*)"|'([^']*)'|(\S+)))?""")
#: Tags whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


def _read(html: str) -> list[list[list[list]]]:
    """The tables that _Reader collects. Pages of plain tags are read by one pattern, all others (comments, scripts, stray signs) by the parser."""
    page, at = _Reader(), 0
    for m in iter(_TAG.scanner(html).match, None):
        data, end, tag, attrs = m.groups()
        at, tag = m.end(), tag.lower()
        if tag in _RAW:
            break
        if data and page.open:
            page.handle_data(entities.unescape(data) if "&" in data else data)
        if tag not in ("table", "tr", "td", "th"):
            continue
        if end:
            if attrs:
                break
            page.handle_endtag(tag)
        else:
            page.handle_starttag(tag, [(k.lower(), entities.unescape(next((v for v in values if v), ""))) for k, *values in _SPAN.findall(attrs)] if attrs else ())
    else:
        if "<" not in html[at:]:
            if page.open and at < len(html):
                page.handle_data(entities.unescape(html[at:]))
            return page.tables
    page = _Reader()
    page.feed(html)
    page.close()
    return page.tables


def _grid(rows: list[list[list]]) -> Iterator[dict[int, tuple[bool, str]]]:
    """A table's rows as (header, text) by column: a cell that spans rows or columns is in each of its places. Text is trimmed, its white space collapsed."""
    below: dict[int, tuple[int, bool, str]] = {}  # by column: rows that a cell from above still takes
    for cells in rows:
        row, col = {}, 0
        for c, (left, header, text) in list(below.items()):
            row[c] = (header, text)
            below[c] = (left - 1, header, text)
            if left == 1:
                del below[c]
        for header, down, across, parts in cells:
            while col in row:
                col += 1
            text = " ".join("".join(parts).split())
            for c in range(col, col + across):
                row[c] = (header, text)
                if down > 1:
                    below[c] = (down - 1, header, text)
            col += across
        yield row


def grid_cells(html: str | None) -> Iterator[tuple[int, int, int, bool, str]]:
    """(table, row, col, header, text) of every place of every table's grid."""
    for t, rows in enumerate(_read(html or "")):
        for r, row in enumerate(_grid(rows)):
            yield from ((t, r, c, *row[c]) for c in sorted(row))


def grid_tables(html: str | None) -> Iterator[tuple]:
    """(table, corner, middle, cells): a table's places in order, each with what it stands beside and below; corner is the first text of row 0, middle its place in column 1 as (header, text). Tables whose row 0 is empty are left out."""
    for t, rows in enumerate(_read(html or "")):
        top, cells, none = None, [], (None, None)
        for r, row in enumerate(_grid(rows)):
            top = row if top is None else top
            first, second = row.get(0, none), row.get(1, none)[1]
            cells += [(r, c, *row[c], *first, second, *top.get(c, none)) for c in sorted(row)]
        if top:
            yield t, top[min(top)][1], top.get(1), cells


@udtf(returnType="table int, corner string, middle struct<header: boolean, text: string>, cells array<struct<row: int, col: int, header: boolean, text: string, label_header: boolean, label: string, second: string, top_header: boolean, top: string>>")
class Tables:
    def eval(self, html: str):
        yield from grid_tables(html)


def tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, corner, middle, cells) of pages, by a lateral join with the table function."""
    return pages.select(key, html).lateralJoin(Tables(F.col(html).outer())).drop(html)


def number(text: Column) -> Column:
    """The number that a text starts with, thousands separators and a percent sign allowed; null if none."""
    return F.regexp_extract(F.regexp_replace(text, ",", ""), r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


#: The layouts: section, which cells count, and what names them and their side. A cell knows its row's first cell (label) and second, and its column's top.
LAYOUTS = {
    "facts": ("fact", "NOT header AND col = 1 AND label_header", "label", "''"),  # a header cell and the cell after it
    "periods": ("period", "NOT header AND row > 0 AND col > 0 AND top_header AND label IS NOT NULL AND lower(top) <> 'total'", "top", "label"),  # a header row of periods over a row for each side
    "comparison": ("stat", "row > 0 AND col IN (0, 2) AND second IS NOT NULL AND top IS NOT NULL", "second", "top"),  # a stat between the values of the two sides, named in the header row
    "sets": ("set", "row > 0 AND col = 2 AND label_header AND second IS NOT NULL", "label", "second"),  # the set's cell spans the rows of its sides
}


def details(pages: DataFrame, key: str) -> DataFrame:
    """(key, section, name, side, value, text): typed rows of all tables of the pages, each read by its layout: periods if its corner says Team, sets if it says Set, a comparison if the middle of three header cells says Stat, facts if its first cell is a label beside a value.

    A cell comes with its headers, so rows are made where a page is read, without a shuffle.
    """
    corner = F.lower("corner")
    layout = F.when(corner == "team", "periods").when(corner == "set", "sets").when(F.lower("middle.text") == "stat", "comparison").when(~F.col("middle.header"), "facts")
    c = tables(pages, key).select(key, layout.alias("layout"), F.inline("cells"))
    by_layout = lambda i: F.expr("CASE layout " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in LAYOUTS.items()) + " END")
    section = F.expr("CASE layout " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in LAYOUTS.items()) + " END")
    return c.where(by_layout(1)).select(key, section.alias("section"), F.lower(by_layout(2)).alias("name"), by_layout(3).alias("side"), number(F.col("text")).alias("value"), "text")


def _pages(m: DataFrame) -> DataFrame:
    """A detail page for each match: four tables with spans, entities and nested markup."""
    i = F.col("match_id")
    s = lambda c: c.cast("string")
    points = lambda k, side: s((i * (7 if side == "a" else 11) + 5 * k) % 30)
    row = lambda side: F.concat(F.lit("<tr><td><b>"), s(F.col(side)), F.lit("</b></td>"), *(F.concat(F.lit("<td>"), points(k, side), F.lit("</td>")) for k in (1, 2, 3)), F.lit("<td>99</td></tr>"))
    first = F.concat(F.lit("<table><tr><th>Team</th><th>Q1</th><th>Q2</th><th>Q3</th><th>Total</th></tr>"), row("a"), row("b"), F.lit("</table>"))
    second = F.concat(F.lit("<table><tr><th>Attendance</th><td>"), F.format_number(i * 37, 0), F.lit("</td></tr><tr><th>Venue</th><td>Hall &amp; Park <i>"), s(i % 7), F.lit("</i></td></tr></table>"))
    third = F.concat(F.lit("<table><tr><th>"), s(F.col("a")), F.lit("</th><th>Stat</th><th>"), s(F.col("b")), F.lit("</th></tr><tr><td>"), s(i % 90), F.lit(".5%</td><td>FG %</td><td>"), s(i % 80), F.lit("%</td></tr></table>"))
    game = lambda k: F.concat(F.lit(f'<tr><th rowspan="2">{k}</th><td>'), s(F.col("a")), F.lit("</td><td>"), s((i + k) % 26), F.lit("</td></tr><tr><td>"), s(F.col("b")), F.lit("</td><td>"), s((i * 3 + k) % 26), F.lit("</td></tr>"))
    fourth = F.concat(F.lit("<table><tr><th>Set</th><th colspan='2'>Points</th></tr>"), game(1), game(2), F.lit("</table>"))
    return m.select("match_id", F.concat(F.lit("<html><body><p>1 - 2</p>"), first, second, third, fourth, F.lit("</body>")).alias("html"))


@query("s14_detail_pages", f"""WITH {MATCHES}, m AS (SELECT match_id AS i, a, b FROM matches),
 r AS (SELECT i AS match_id, 'period' AS section, 'q' || k AS name, CAST(a AS VARCHAR) AS side, (i * 7 + 5 * k) % 30 AS value FROM m, range(1, 4) t(k)
  UNION ALL SELECT i, 'period', 'q' || k, CAST(b AS VARCHAR), (i * 11 + 5 * k) % 30 FROM m, range(1, 4) t(k)
  UNION ALL SELECT i, 'set', CAST(k AS VARCHAR), CAST(a AS VARCHAR), (i + k) % 26 FROM m, range(1, 3) t(k)
  UNION ALL SELECT i, 'set', CAST(k AS VARCHAR), CAST(b AS VARCHAR), (i * 3 + k) % 26 FROM m, range(1, 3) t(k)
  UNION ALL SELECT i, 'stat', 'fg %', CAST(a AS VARCHAR), i % 90 + 0.5 FROM m UNION ALL SELECT i, 'stat', 'fg %', CAST(b AS VARCHAR), i % 80 FROM m
  UNION ALL SELECT i, 'fact', 'attendance', '', i * 37 FROM m UNION ALL SELECT i, 'fact', 'venue', '', NULL FROM m)
SELECT match_id, section, name, side, CAST(value AS DOUBLE) AS value, CASE WHEN name = 'venue' THEN 'Hall & Park ' || match_id % 7 END AS text FROM r""")
def s14(spark, sf):
    x = details(_pages(matches(spark, sf)), "match_id")
    return x.select("match_id", "section", "name", "side", "value", F.when(F.col("name") == "venue", F.col("text")).alias("text"))
