"""Rows of a result as text: list, csv, column, table, json and line; statements of a file; definitions of a database."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from brindle.database import Database, Result
from brindle.sources.csv import definition

WIDEST = 60


def _cell(v, null: str) -> str:
    if v is None:
        return null
    if isinstance(v, bytes | bytearray):
        return f"X'{bytes(v).hex().upper()}'"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return str(int(v))
    return str(int(v)) if isinstance(v, bool) else str(v)


def _csv(cells: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in cells)


def _streamed(line: Callable[[list[str]], str]):
    """Formats that show each row by itself: rows come from the partitions one after another."""

    def lines(result: Result, headers: bool, null: str) -> Iterator[str]:
        if headers:
            yield line(list(result.columns))
        for r in result.df.toLocalIterator():
            yield line([_cell(v, null) for v in r])

    return lines


def _aligned(bordered: bool):
    """Formats whose widths depend on all rows, which are gathered for it."""

    def lines(result: Result, headers: bool, null: str) -> Iterator[str]:
        rows = [[_cell(v, null) for v in r] for r in result]
        widths = [min(WIDEST, max([len(c), *(len(r[i]) for r in rows)])) for i, c in enumerate(result.columns)]
        border = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        if bordered:
            shown = lambda r: "|" + "|".join(f" {c:{w}} " for c, w in zip(r, widths, strict=True)) + "|"
            yield border
        else:
            shown = lambda r: "".join(f"{c:{w}}  " for c, w in zip(r, widths, strict=True))
        if headers:
            yield shown(result.columns)
            yield border if bordered else "".join("-" * w + "  " for w in widths)
        yield from map(shown, rows)
        if bordered:
            yield border

    return lines


def _json(result: Result, headers: bool, null: str) -> Iterator[str]:
    before = "["
    for r in result.df.toLocalIterator():
        yield before if before == "[" else before + ","
        values = (v if v is None or isinstance(v, int | float | str) else _cell(v, null) for v in r)
        before = "  {" + ", ".join(f"{json.dumps(c, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}" for c, v in zip(result.columns, values, strict=True)) + "}"
    yield before
    yield "]"


def _line(result: Result, headers: bool, null: str) -> Iterator[str]:
    width = max(map(len, result.columns), default=0)
    for k, r in enumerate(result.df.toLocalIterator()):
        if k:
            yield ""
        yield from (f"{c:>{width}} = {_cell(v, null)}" for c, v in zip(result.columns, r, strict=True))


MODES = {"list": _streamed("|".join), "csv": _streamed(_csv), "column": _aligned(False), "table": _aligned(True), "json": _json, "line": _line}


def rendered(result: Result, mode: str = "list", headers: bool = True, null: str = "") -> Iterator[str]:
    """The lines of a result in one of MODES. column and table gather all rows first; the others stream them."""
    return MODES[mode](result, headers, null)


def read_file(db: Database, path: str) -> int:
    """Runs the statements of a file; the number of changed rows."""
    with open(path, encoding="utf-8") as f:
        return db.execute(f.read())


def schema(db: Database) -> list[str]:
    """CREATE statements of all tables, indexes, views and triggers."""
    return list(definition(db))
