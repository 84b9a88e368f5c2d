"""Nested lists and tables of pages, by interval labels.

Every element has an open and a close rank in document order; an element lies in another one if its interval does. Lists and
tables keep the labels, so nesting of any kind (a list in a table cell, a table in a list item) is a comparison of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.functions.dom import Node, parse
from acadspark.operators.listings import extract_with

MOST_COLUMNS = 1000  # fixed value: larger column spans count as this
MOST_ROWS = 65534  # fixed value: larger row spans count as this


def intervals(root: Node) -> dict[int, tuple[int, int]]:
    """Open and close rank of every element by identity."""
    out, rank, stack = {}, 0, [(root, None)]
    while stack:
        node, opened = stack.pop()
        rank += 1
        if opened is not None:
            out[id(node)] = (opened, rank)
            continue
        stack.append((node, rank))
        stack.extend((k, None) for k in reversed(node.kids) if isinstance(k, Node))
    return out


def _above(node: Node, tags: tuple[str, ...]) -> Node | None:
    up = node.up
    while up is not None and up.tag not in tags:
        up = up.up
    return up


def _own_text(node: Node, without: tuple[str, ...]) -> str:
    """Text of an element except below inner elements of the given tags."""
    parts, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(k)
        elif k.tag not in without:
            stack.extend(reversed(k.kids))
    return " ".join(" ".join(parts).split())


def _list_rows(html: str, url: str) -> Iterator[dict]:
    root = parse(html)
    place = intervals(root)
    depth: dict[int, int] = {}
    count: dict[int, int] = {}
    for node in (n for n in root.nodes() if n.tag in ("ul", "ol", "li")):
        home = _above(node, ("ul", "ol"))
        if node.tag != "li":
            depth[id(node)] = depth[id(home)] + 1 if home else 1
            continue
        if home is None:
            continue
        count[id(home)] = count.get(id(home), 0) + 1
        up = _above(home, ("ul", "ol"))
        item = _above(home, ("li",)) if up else None
        yield {"list_open": place[id(home)][0], "list_close": place[id(home)][1], "parent_open": place[id(up)][0] if up else None, "parent_item_open": place[id(item)][0] if item else None,
               "depth": depth[id(home)], "list_type": home.tag, "item_no": count[id(home)], "item_open": place[id(node)][0], "text": _own_text(node, ("ul", "ol", "li"))}


def nested_lists(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Items of all lists, nested ones included: their list's interval, depth and type, the open rank of the list and the item
    around it (null for outer lists), the item's number and its text without that of inner lists."""
    schema = "list_open bigint, list_close bigint, parent_open bigint, parent_item_open bigint, depth bigint, list_type string, item_no bigint, item_open bigint, text string"
    return extract_with(pages, _list_rows, schema, keep)


def _span(node: Node, name: str, most: int) -> int:
    raw = node.attrs.get(name, "").strip()
    return min(int(raw), most) if raw.isascii() and raw.isdigit() and len(raw) < 10 else 1


def _cells(table: Node) -> Iterator[tuple[Node, int, int, int, int]]:
    """(cell, row, column, rows, columns) of a table, its spans laid out on a grid; a span of no rows reaches to the end."""
    rows = [n for n in table.nodes() if n.tag == "tr" and _above(n, ("table",)) is table]
    taken: dict[int, int] = {}  # column: first row in which it is free again
    for r, row in enumerate(rows):
        column = 0
        for cell in (n for n in row.nodes() if n.tag in ("td", "th") and _above(n, ("tr",)) is row):
            while taken.get(column, 0) > r:
                column += 1
            wide = max(1, _span(cell, "colspan", MOST_COLUMNS))
            high = min(_span(cell, "rowspan", MOST_ROWS) or len(rows), len(rows) - r)
            for c in range(column, column + wide):
                taken[c] = r + high
            yield cell, r, column, high, wide
            column += wide


def _table_rows(html: str, url: str) -> Iterator[dict]:
    root = parse(html)
    place = intervals(root)
    seat: dict[int, tuple[int, int]] = {}
    depth: dict[int, int] = {}
    for table in root.find("table"):
        up = _above(table, ("table",))
        depth[id(table)] = depth[id(up)] + 1 if up else 1
        around = _above(table, ("td", "th")) if up else None
        r0, c0 = seat.get(id(around), (None, None))
        for cell, r, c, high, wide in _cells(table):
            seat[id(cell)] = (r, c)
            yield {"table_open": place[id(table)][0], "table_close": place[id(table)][1], "parent_open": place[id(up)][0] if up else None, "parent_row": r0, "parent_col": c0,
                   "depth": depth[id(table)], "row_no": r, "col_no": c, "row_span": high, "col_span": wide, "header": cell.tag == "th", "text": _own_text(cell, ("table",))}


def nested_tables(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Cells of all tables, nested ones included: their table's interval and depth, the table and cell around it (null for outer
    tables), row, column and spans on the table's grid, and the text without that of inner tables."""
    schema = ("table_open bigint, table_close bigint, parent_open bigint, parent_row bigint, parent_col bigint, depth bigint, row_no bigint, col_no bigint, row_span bigint, "
              "col_span bigint, header boolean, text string")
    return extract_with(pages, _table_rows, schema, keep)


def grid(cells: DataFrame) -> DataFrame:
    """Cells of ``nested_tables`` once for each place that they span."""
    r = F.explode(F.sequence("row_no", F.col("row_no") + F.col("row_span") - 1))
    wide = cells.withColumn("row_no", r)
    return wide.withColumn("col_no", F.explode(F.sequence("col_no", F.col("col_no") + F.col("col_span") - 1))).drop("row_span", "col_span")
