"""A small query language over rows of (line_no, text, template, slots), compiled to Columns.

    query  := SELECT target [WHERE or] [LIMIT int]
    target := lines | (count | min | max | avg) [ "(" [field] ")" ]
    or     := and (OR and)*        and := prim (AND prim)*
    prim   := "(" or ")" | [NOT] field LIKE 'pattern' | [NOT] field op value     op: > < >= <= = !=
    field  := template | text | slot[N]

LIKE ignores case and its wildcards don't match line feeds. A comparison is numeric where both sides are numbers; where only the right one is, ordering is false and equality
compares strings; otherwise it compares strings. NOT holds for comparisons too. LIMIT takes the first rows that pass, before any aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memquarry.functions.text import NUMBER, number

_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^']|'')*'|"[^"]*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<op>>=|<=|!=|=|>|<)|(?P<mark>[()\[\]])|(?P<word>[A-Za-z_]\w*))""")
AGGREGATES = ("count", "min", "max", "avg")


class CqlError(ValueError):
    pass


@dataclass
class Query:
    target: str
    field: str | None
    where: tuple | None
    limit: int | None


def tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise CqlError(f"unexpected {query[at:at + 10]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "string":
            value = value[1:-1].replace("''", "'") if value[0] == "'" else value[1:-1]
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, query: str):
        self.rest = tokens(query)

    def next_is(self, *words: str) -> bool:
        return bool(self.rest) and self.rest[0][0] in ("word", "mark", "op") and self.rest[0][1].lower() in words

    def take(self, *words: str) -> str:
        if not self.next_is(*words):
            raise CqlError(f"expected {' or '.join(words)}, found {self.rest[0][1] if self.rest else 'the end'}")
        return self.rest.pop(0)[1].lower()

    def field(self) -> str:
        name = self.take("template", "text", "slot")
        if name != "slot":
            return name
        self.take("[")
        if not self.rest or self.rest[0][0] != "number" or not self.rest[0][1].isdigit():
            raise CqlError("a slot's number is missing")
        n = self.rest.pop(0)[1]
        self.take("]")
        return f"slot[{n}]"

    def query(self) -> Query:
        self.take("select")
        target, field, where, limit = self.take("lines", *AGGREGATES), None, None, None
        if target != "lines" and self.next_is("("):
            self.take("(")
            field = None if self.next_is(")") else self.field()
            self.take(")")
        if self.next_is("where"):
            self.take("where")
            where = self.either()
        if self.next_is("limit"):
            self.take("limit")
            if not self.rest or self.rest[0][0] != "number" or not self.rest[0][1].isdigit():
                raise CqlError("LIMIT needs a number")
            limit = int(self.rest.pop(0)[1])
        if self.rest:
            raise CqlError(f"unexpected {self.rest[0][1]!r}")
        return Query(target, field, where, limit)

    def either(self) -> tuple:
        left = self.both()
        while self.next_is("or"):
            self.take("or")
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.single()
        while self.next_is("and"):
            self.take("and")
            left = ("and", left, self.single())
        return left

    def single(self) -> tuple:
        if self.next_is("("):
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        negated = self.next_is("not") and bool(self.take("not"))
        field = self.field()
        op = self.take("like", ">", "<", ">=", "<=", "=", "!=")
        if not self.rest or self.rest[0][0] not in ("string", "number", "word"):
            raise CqlError("a value is missing")
        kind, value = self.rest.pop(0)
        if op == "like" and kind != "string":
            raise CqlError("LIKE needs a quoted pattern")
        out = (op, field, value)
        return ("not", out) if negated else out


def parse(query: str) -> Query:
    return _Parser(query).query()


def column(field: str | None) -> Column:
    if field and field.startswith("slot["):
        return F.coalesce(F.get("slots", F.lit(int(field[5:-1]))), F.lit(""))
    return F.col(field or "text")


def like(c: Column, pattern: str) -> Column:
    body = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern)
    return c.rlike(f"(?iu)^{body}\\z")


def predicate(node: tuple) -> Column:
    if node[0] == "and":
        return predicate(node[1]) & predicate(node[2])
    if node[0] == "or":
        return predicate(node[1]) | predicate(node[2])
    if node[0] == "not":
        return ~predicate(node[1])
    op, field, value = node
    c = column(field)
    if op == "like":
        return like(c, value)
    compare = {"=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}[op]
    if not re.match(NUMBER, value):
        return compare(c, F.lit(value))
    n = number(c)
    fallback = compare(c, F.lit(value)) if op in ("=", "!=") else F.lit(False)
    return F.when(n.isNotNull(), compare(n, F.lit(float(value)))).otherwise(fallback)


def execute(rows: DataFrame, query: str) -> DataFrame:
    """`text` (with line_no) of the rows that pass, or one row with the aggregate in `value`; an aggregate over no number is null, a count 0."""
    q = parse(query)
    out = rows.where(predicate(q.where)) if q.where else rows
    if q.limit is not None:
        out = out.orderBy("line_no").limit(q.limit)
    if q.target == "lines":
        return out.select("line_no", "text")
    if q.target == "count":
        return out.agg(F.count(F.lit(1)).alias("value"))
    return out.agg(getattr(F, q.target)(number(column(q.field))).alias("value"))
