"""Sheet formulas: sums and ranges over cells.

Grammar: numbers, cell references (also ``[.A1]``, ranges ``A1:B2``), + - * / and unary minus, parentheses, and SUM,
AVERAGE, MIN, MAX, COUNT with ``;`` or ``,``. Anything else, division by zero, a cycle or a depth over 256 gives null.

Spark joins the references of all formulas to the cells, by blocks of rows, and aggregates what each range holds. A small
function then works out the formulas of a sheet from those aggregates: of the cells it sees the formulas alone.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import cell_ref

MOST_DEPTH, MOST_CELLS, BLOCK = 256, 1_000_000, 1024
_REFERENCE = r"\$?[A-Za-z]{1,3}\$?[0-9]{1,7}(?::\.?\$?[A-Za-z]{1,3}\$?[0-9]{1,7})?"
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|\[?\.?\$?([A-Za-z]{1,3})\$?(\d+)(?::\.?\$?([A-Za-z]{1,3})\$?(\d+))?\]?(?!\w|\()|([A-Za-z]+)(?=\s*\()|([-+*/(),;]))")
_NOTHING = (0.0, 0, math.inf, -math.inf)
#: Of (sum, count, least, greatest) of all arguments.
_FUNCTIONS = {"SUM": lambda s: s[0], "AVERAGE": lambda s: s[0] / s[1], "MIN": lambda s: s[2] if s[1] else 0.0, "MAX": lambda s: s[3] if s[1] else 0.0, "COUNT": lambda s: float(s[1])}


def column_index(name: str) -> int:
    out = 0
    for c in name.upper():
        out = out * 26 + ord(c) - 64
    return out - 1


def _both(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])


class Sheet:
    """held: (top, left, bottom, right) to (sum, count, least, greatest) of the values there; formulas: (row, column) to
    text. Places are 0-based; a rectangle that is not held has no values."""

    def __init__(self, held: dict, formulas: dict) -> None:
        self.held, self.formulas, self.known, self.open = held, formulas, {}, set()

    def cell(self, at: tuple[int, int], depth: int = 0) -> float | None:
        """The value of the formula at a place, null for one that is open: a cycle."""
        if at not in self.known:
            if at in self.open or depth > MOST_DEPTH:
                return None
            self.open.add(at)
            self.known[at] = self.evaluate(self.formulas[at], depth + 1)
            self.open.discard(at)
        return self.known[at]

    def block(self, t: tuple, depth: int) -> tuple:
        """What a reference holds: values, and formulas that have one."""
        r1, c1 = int(t[2]) - 1, column_index(t[1])
        r2, c2 = (int(t[4]) - 1, column_index(t[3])) if t[3] else (r1, c1)
        top, left, bottom, right = min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)
        if (bottom - top + 1) * (right - left + 1) > MOST_CELLS:
            raise ArithmeticError
        out = self.held.get((top, left, bottom, right), _NOTHING)
        inside = ((top, left),) if top == bottom and left == right else self.formulas
        for at in inside:
            if at in self.formulas and top <= at[0] <= bottom and left <= at[1] <= right and (v := self.cell(at, depth)) is not None:
                out = _both(out, (v, 1, v, v))
        return out

    def evaluate(self, text: str, depth: int = 0) -> float | None:
        tokens, at, text = [], 0, re.sub(r"^\s*(?:of:)?=", "", text)
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                return None
            tokens.append(m.groups())
            at = m.end()
        tokens.reverse()  # the next one is the last
        op = lambda i=-1: tokens[i][6] if len(tokens) >= -i else None

        def take(sign):
            if op() != sign:
                raise ArithmeticError
            tokens.pop()

        def factor(level):
            if level > MOST_DEPTH or not tokens:
                raise ArithmeticError
            t = tokens.pop()
            if t[0]:
                return float(t[0])
            if t[1]:
                total, count, *_ = self.block(t, depth)
                if t[3] or not count:
                    raise ArithmeticError
                return total
            if t[5]:
                return called(t[5].upper(), level)
            if t[6] == "-":
                return -factor(level + 1)
            if t[6] == "(":
                v = expression(level + 1)
                take(")")
                return v
            raise ArithmeticError

        def called(name, level):
            take("(")
            held = _NOTHING
            while op() != ")":
                if tokens and tokens[-1][1] and op(-2) in (")", ",", ";"):
                    held = _both(held, self.block(tokens.pop(), depth))
                else:
                    v = expression(level + 1)
                    held = _both(held, (v, 1, v, v))
                if op() in (",", ";"):
                    tokens.pop()
                elif op() != ")":
                    raise ArithmeticError
            take(")")
            if name not in _FUNCTIONS:
                raise ArithmeticError
            return _FUNCTIONS[name](held)

        def chain(next_of, signs, level):
            v = next_of(level)
            while (sign := op()) in signs:
                tokens.pop()
                w = next_of(level)
                v = v + w if sign == "+" else v - w if sign == "-" else v * w if sign == "*" else v / w
            return v

        def expression(level):
            return chain(lambda n: chain(factor, ("*", "/"), n), ("+", "-"), level)

        try:
            v = expression(0)
        except ArithmeticError:
            return None
        return v if not tokens and math.isfinite(v) else None


def references(formulas: DataFrame) -> DataFrame:
    """(doc_id, sheet, top, left, bottom, right): each rectangle that a sheet's formulas name, once."""
    named = formulas.select("doc_id", "sheet", F.explode(F.regexp_extract_all("formula", F.lit(_REFERENCE), F.lit(0))).alias("ref"))
    ends = F.split(F.replace("ref", F.lit("."), F.lit("")), ":")
    (r1, c1), (r2, c2) = cell_ref(ends[0]), cell_ref(F.coalesce(F.try_element_at(ends, F.lit(2)), ends[0]))
    rows = named.select("doc_id", "sheet", F.least(r1, r2).alias("top"), F.least(c1, c2).alias("left"), F.greatest(r1, r2).alias("bottom"), F.greatest(c1, c2).alias("right"))
    return rows.filter((F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1) <= MOST_CELLS).distinct()


def held_values(cells: DataFrame, references: DataFrame) -> DataFrame:
    """``references`` with total, count, least and greatest of the values in them. Joined by sheet and block of rows, so that
    a sheet with very many cells is in as many parts as it has blocks."""
    asked = references.withColumn("block", F.explode(F.sequence(F.floor(F.col("top") / BLOCK), F.floor(F.col("bottom") / BLOCK))))
    values = cells.filter("value is not null and not isnan(value)").select("doc_id", "sheet", F.col("row").alias("r"), F.col("col").alias("c"), "value", F.floor(F.col("row") / BLOCK).alias("block"))
    inside = F.col("r").between(F.col("top"), F.col("bottom")) & F.col("c").between(F.col("left"), F.col("right"))
    found = asked.join(values, ["doc_id", "sheet", "block"]).filter(inside)
    return found.groupBy(*references.columns).agg(F.sum("value").alias("total"), F.count("*").alias("count"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def evaluated(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet, row, col, value) of the formula cells without a value among (doc_id, sheet, row, col, value,
    formula), a row for each place. Null sheets are left out, as no reference can name their cells. A sheet's formulas and
    the aggregates of the ranges they name are the unit of work, never its cells."""
    cells = cells.filter("doc_id is not null and sheet is not null")
    formulas = cells.filter("value is null and formula is not null").select("doc_id", "sheet", "row", "col", "formula")
    held = held_values(cells, references(formulas))

    def each(table):
        c = table.to_pydict()
        texts = {(r, k): f for r, k, f in zip(c["row"], c["col"], c["formula"], strict=True) if f is not None}
        places, values = zip(c["top"], c["left"], c["bottom"], c["right"], strict=True), zip(c["total"], c["count"], c["least"], c["greatest"], strict=True)
        sheet = Sheet({at: v for at, v in zip(places, values, strict=True) if v[1] is not None}, texts)
        out = [c["doc_id"][:1] * len(texts), c["sheet"][:1] * len(texts), [r for r, _ in texts], [k for _, k in texts], [sheet.cell(at) for at in texts]]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "sheet", "row", "col", "value"])

    rows = formulas.unionByName(held, allowMissingColumns=True)
    return rows.groupBy("doc_id", "sheet").applyInArrow(each, "doc_id long, sheet string, row int, col int, value double")
