"""Result documents and console tables: small results, nested and coerced."""

from __future__ import annotations

import datetime
import decimal
import json
import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Row

#: Rows of a section beyond which a result is no document.
MAX_ROWS = 100_000


def plain(x: object) -> object:
    """A value as JSON has it: sets sorted, rows as objects, numbers of other kinds as numbers, not-a-number as null."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, Mapping):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, set | frozenset):
        return sorted((plain(v) for v in x), key=lambda v: (str(type(v)), v if isinstance(v, int | float | str) else str(v)))
    if isinstance(x, list | tuple | np.ndarray):
        return [plain(v) for v in x]
    if isinstance(x, np.generic):
        return plain(x.item())
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, datetime.date | datetime.datetime):
        return x.isoformat()
    if isinstance(x, bytes | bytearray):
        return bytes(x).hex()
    return x


def section(df: DataFrame, keys: tuple[str, ...] = ()) -> object:
    """The rows of a small result: a list, or objects nested by the key columns; a single row without keys is one object."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: write them as a table")
    if not keys:
        return plain(rows[0]) if len(rows) == 1 else plain(rows)
    out: dict = {}
    for r in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(r[k]), {})
        rest = {c: plain(r[c]) for c in df.columns if c not in keys}
        at[str(r[keys[-1]])] = next(iter(rest.values())) if len(rest) == 1 else rest
    return out


def write_document(path: str, sections: dict[str, object]) -> dict:
    """One JSON document of named sections, which may be nested objects; gives what was written."""
    doc = plain(sections)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=1, ensure_ascii=False, allow_nan=False)
        f.write("\n")
    return doc


def console_table(df: DataFrame, digits: int = 3, most: int = 50) -> str:
    """The first rows as aligned text: numbers right, with so many digits; a line says how many more there are, if any."""
    rows = df.limit(most + 1).collect()
    show = lambda x: "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    cells = [[show(v) for v in r] for r in rows[:most]]
    right = [all(isinstance(r[i], int | float | type(None)) for r in rows) for i in range(len(df.columns))]
    width = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(df.columns)]
    line = lambda r: "  ".join(v.rjust(w) if x else v.ljust(w) for v, w, x in zip(r, width, right, strict=True)).rstrip()
    out = [line(df.columns), line(["-" * w for w in width]), *map(line, cells)]
    return "\n".join([*out, "..."] if len(rows) > most else out)
