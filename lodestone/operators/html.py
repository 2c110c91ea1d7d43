"""HTML as tables and text: a table function for tables, expressions for the rest."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestone.functions.columns import col
from lodestone.functions.scalars import collapse_space, dollars


class _Tables(HTMLParser):
    """Rows of the outermost tables; nested tables are left out."""

    def __init__(self):
        super().__init__()
        self.depth, self.table, self.row = 0, -1, -1
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None
        self.rows: list[tuple[int, int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.table, self.row = self.table + 1, -1
        elif self.depth == 1 and tag == "tr":
            self.end_row()
            self.cells = []
        elif self.depth == 1 and tag in ("td", "th"):
            self.end_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table":
            if self.depth == 1:
                self.end_row()
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag == "tr":
            self.end_row()
        elif self.depth == 1 and tag in ("td", "th"):
            self.end_cell()

    def handle_data(self, data):
        if self.depth == 1 and self.cell is not None:
            self.cell.append(data)

    def end_cell(self):
        if self.cell is not None and self.cells is not None:
            self.cells.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def end_row(self):
        self.end_cell()
        if self.cells:
            self.row += 1
            self.rows.append((self.table, self.row, self.cells))
        self.cells = None


@udtf(returnType="table_no int, row_no int, cells array<string>", useArrow=True)
class HtmlTables:
    def eval(self, page: str):
        if page is None:
            return
        parser = _Tables()
        parser.feed(page)
        parser.close()
        parser.end_row()
        yield from parser.rows


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_no, row_no, cells) of every row of every outermost table."""
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("page")).lateralJoin(HtmlTables(F.col("page").outer())).drop("page").withColumnRenamed("id", id_col)


def table_records(rows: DataFrame, id_col: str, header: list[str]) -> DataFrame:
    """Records (id, row_no, record map) of the tables whose first row is exactly `header`;
    rows of another width are left out."""
    head = rows.where((F.col("row_no") == 0) & (F.col("cells") == F.array(*map(F.lit, header)))).select(id_col, "table_no")
    body = rows.where((F.col("row_no") > 0) & (F.size("cells") == len(header))).join(head, [id_col, "table_no"])
    return body.select(id_col, "row_no", F.map_from_arrays(F.array(*map(F.lit, header)), "cells").alias("record"))


# Fixed values of HTML: character references, the ampersand last.
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "amp": "&"}


def visible_text(page: Column | str) -> Column:
    """Text outside comments, script and style, the common character references decoded, white
    space collapsed."""
    x = F.regexp_replace(col(page), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for name, char in REFERENCES.items():
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return collapse_space(x)


def page_title(page: Column | str) -> Column:
    return F.regexp_extract(col(page), r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_links(page: Column | str) -> Column:
    return F.regexp_extract_all(col(page), F.lit(r'href="([^"]*)"'), 1)


def price_facts(rows: DataFrame, id_col: str, header: list[str], label: str, prices: dict[str, str], discounted_cells: bool = False) -> DataFrame:
    """(id, name, category, raw_amount) of a price table: `prices` maps a column to its
    category; cells without a plain amount give no row."""
    records = table_records(rows, id_col, header)
    parts = F.array(*[F.struct(F.lit(c).alias("category"), dollars(F.element_at("record", h), discounted_cells).alias("raw_amount")) for h, c in prices.items()])
    return records.select(id_col, F.element_at("record", label).alias("name"), F.explode(parts).alias("p")).select(id_col, "name", "p.*").where(F.col("raw_amount").isNotNull())


def token_limits(text: Column) -> Column:
    """(context_length, max_output_tokens) as a page states them, null where it doesn't."""
    number = lambda i: F.replace(F.regexp_extract(text, r"([\d,]+) context window ([\d,]+) max output tokens", i), F.lit(",")).try_cast("bigint")
    return F.struct(number(1).alias("context_length"), number(2).alias("max_output_tokens"))


def leaderboard_scores(rows: DataFrame, id_col: str, header: list[str], label: str, score: str) -> DataFrame:
    """(id, label, score) of a leaderboard: percent signs go, what is no number gives no row."""
    value = F.rtrim(F.element_at("record", score))
    value = F.regexp_replace(value, "%$", "")
    out = table_records(rows, id_col, header).select(id_col, F.element_at("record", label).alias("label"), value.alias("text"))
    return out.where(F.col("text").rlike(r"^\d+(\.\d+)?$")).select(id_col, "label", F.col("text").cast("decimal(18,6)").alias("score"))


def missing_schema(sources: DataFrame, facts: DataFrame, id_col: str) -> DataFrame:
    """Sources that gave no fact: their layout is not the known one."""
    return sources.join(facts.select(id_col).distinct(), id_col, "left_anti")
