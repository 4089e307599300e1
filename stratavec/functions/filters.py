"""Filters: one-predicate strings compiled to Columns, and typed conjunctions.

A string filter is one predicate.  Operators are looked for in a fixed order of
kinds, wherever they stand: null tests at the end, then keywords, then signs.
A string without an operator holds for every row.  A null operand makes any
predicate but the null tests false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..types import MetadataOp

#: The order in which operators are looked for.
KEYWORDS = ["NOT_CONTAIN_ALL", "NOT_CONTAIN_ANY", "CONTAIN_ALL", "CONTAIN_ANY", "HAS_PREFIX", "HAS_SUFFIX", "LIKE"]
SIGNS = [">=", "<=", ">", "<", "!=", "==", "="]
PRESENT = "_present"


@dataclass(frozen=True)
class Predicate:
    """A parsed filter; op is a keyword, a sign, IS_NULL, IS_NOT_NULL or empty (always true)."""

    field: str = ""
    op: str = ""
    value: str = ""


def parse(text: str) -> Predicate:
    text = text.strip()
    for op in ("IS_NULL", "IS_NOT_NULL"):
        if text.endswith(" " + op):
            return Predicate(text[: -len(op) - 1].strip(), op)
    for op in KEYWORDS:
        name, found, value = text.partition(f" {op} ")
        if found:
            return Predicate(name.strip(), op, value.strip())
    for op in SIGNS:
        name, found, value = text.partition(op)
        if found:
            return Predicate(name.strip(), op, value.strip())
    return Predicate()


def number(text: str) -> float | None:
    try:
        return float(text) if not re.search(r"\s", text) else None
    except ValueError:
        return None


def wildcard(pattern: str) -> str:
    """Anchored regular expression of a pattern with * and ?."""
    special = set("\\^$.|()[]{}+")
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern)
    return f"(?s)\\A{body}\\z"


def _numeric(c: Column, kind: T.DataType) -> Column:
    """The value as double; text, booleans and binaries count as 0."""
    return c.cast("double") if isinstance(kind, T.NumericType) else F.lit(0.0)


def compile_filter(text: str, schema: T.StructType) -> Column:
    """A boolean Column (never null) for a filter over columns of `schema`."""
    p = parse(text)
    if not p.op:
        return F.lit(True)
    if p.field not in schema.fieldNames():
        return F.lit(False)
    c, kind = F.col(f"`{p.field}`"), schema[p.field].dataType
    present = F.array_contains(PRESENT, p.field) if PRESENT in schema.fieldNames() else F.lit(True)
    if p.op == "IS_NULL":
        return F.coalesce(present & c.isNull(), F.lit(False))
    if p.op == "IS_NOT_NULL":
        return c.isNotNull()
    string = isinstance(kind, T.StringType)
    s = c if string else F.when(c.isNotNull(), F.lit(""))
    if p.op in KEYWORDS:
        items = [x.strip() for x in p.value.split(",")]
        every = reduce(lambda a, b: a & b, [s.contains(x) for x in items])
        some = reduce(lambda a, b: a | b, [s.contains(x) for x in items])
        made = {
            "LIKE": s.rlike(wildcard(p.value)), "HAS_PREFIX": s.startswith(p.value), "HAS_SUFFIX": s.endswith(p.value),
            "CONTAIN_ALL": every, "CONTAIN_ANY": some, "NOT_CONTAIN_ALL": ~every, "NOT_CONTAIN_ANY": ~some,
        }[p.op]
        return F.coalesce(made, F.lit(False))
    value, x = number(p.value), _numeric(c, kind)
    fits = c.isNotNull()
    if p.op in ("==", "=", "!="):
        by_number = (x == F.lit(value)) & ~F.isnan(x) if value is not None and value == value else F.lit(False)
        plain = by_number if value is not None else F.lit(p.value == "")  # of an empty string or a value that isn't text
        same = F.when(s != "", s == p.value).otherwise(plain) if string else plain
        return F.coalesce(fits & (~same if p.op == "!=" else same), F.lit(False))
    if value is None or value != value:
        return F.lit(False)
    bound = F.lit(value)
    made = {">=": x >= bound, "<=": x <= bound, ">": x > bound, "<": x < bound}[p.op]
    return F.coalesce(fits & ~F.isnan(x) & made, F.lit(False))


@dataclass
class MetadataFilter:
    """Typed conditions that all hold.

    By default any column of a fitting type can be used.  With strict=True only
    non-empty strings, 64-bit integers and booleans match, as in an index of
    just these.
    """

    strict: bool = False
    conditions: list[tuple[str, MetadataOp, object]] = field(default_factory=list)

    def _with(self, name: str, op: MetadataOp, value: object) -> MetadataFilter:
        return MetadataFilter(self.strict, [*self.conditions, (name, op, value)])

    def eq(self, name: str, value: str) -> MetadataFilter:
        return self._with(name, MetadataOp.EQ, str(value))

    def is_in(self, name: str, values: list[str]) -> MetadataFilter:
        return self._with(name, MetadataOp.IN, [str(v) for v in values])

    def int_eq(self, name: str, value: int) -> MetadataFilter:
        return self._with(name, MetadataOp.EQ, int(value))

    def int_in(self, name: str, values: list[int]) -> MetadataFilter:
        return self._with(name, MetadataOp.IN, [int(v) for v in values])

    def bool_eq(self, name: str, value: bool) -> MetadataFilter:
        return self._with(name, MetadataOp.EQ, bool(value))

    def int_gt(self, name: str, value: int) -> MetadataFilter:
        return self._with(name, MetadataOp.GT, int(value))

    def int_lt(self, name: str, value: int) -> MetadataFilter:
        return self._with(name, MetadataOp.LT, int(value))

    def int_gte(self, name: str, value: int) -> MetadataFilter:
        return self._with(name, MetadataOp.GTE, int(value))

    def int_lte(self, name: str, value: int) -> MetadataFilter:
        return self._with(name, MetadataOp.LTE, int(value))

    def int_ne(self, name: str, value: int) -> MetadataFilter:
        return self._with(name, MetadataOp.NE, int(value))

    def exists(self, name: str) -> MetadataFilter:
        return self._with(name, MetadataOp.EXISTS, None)

    def column(self, schema: T.StructType) -> Column:
        return reduce(lambda a, b: a & b, [self._one(schema, *c) for c in self.conditions], F.lit(True))

    def _one(self, schema: T.StructType, name: str, op: MetadataOp, value) -> Column:
        if name not in schema.fieldNames():
            return F.lit(False)
        c, kind = F.col(f"`{name}`"), schema[name].dataType
        string, flag = isinstance(kind, T.StringType), isinstance(kind, T.BooleanType)
        whole = isinstance(kind, T.LongType) if self.strict else isinstance(kind, T.IntegralType)
        if op == MetadataOp.EXISTS:
            if self.strict and not (string or flag or whole):
                return F.lit(False)
            return (c.isNotNull() & (c != "")) if string else c.isNotNull()
        one = value[0] if isinstance(value, list) and value else value
        if isinstance(value, list) and not value:
            return F.lit(False)
        fits = flag if isinstance(one, bool) else whole if isinstance(one, int) else string
        if not fits:
            return F.lit(False)
        if string:
            c = F.when(c != "", c)
        makers = {
            MetadataOp.EQ: lambda: c == value, MetadataOp.IN: lambda: c.isin(value), MetadataOp.NE: lambda: c != value, MetadataOp.GT: lambda: c > value,
            MetadataOp.LT: lambda: c < value, MetadataOp.GTE: lambda: c >= value, MetadataOp.LTE: lambda: c <= value,
        }
        if op not in makers:
            raise InvalidArgument(f"unknown metadata operator {op}")
        return F.coalesce(makers[op](), F.lit(False))


def as_condition(given, schema: T.StructType) -> Column:
    """A filter given as string, MetadataFilter, Column or None."""
    if given is None:
        return F.lit(True)
    if isinstance(given, Column):
        return F.coalesce(given, F.lit(False))
    return compile_filter(given, schema) if isinstance(given, str) else given.column(schema)
