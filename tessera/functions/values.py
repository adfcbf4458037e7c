"""Predicates and orders over values of any type, as column expressions.

Values of different types are ordered by type rank; numbers compare exactly, whether int or float. A column of a typed
table has one type, so a comparison across ranks folds to a constant and the rest are plain predicates that reach the
scan. A null in a typed table is an absent key: no predicate holds for it, and it sorts as the lowest value.

Schemaless bodies are maps from key to a tagged value with a sort key, a binary string whose byte order is the total order.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranks of the total order, and the most and least 64-bit integers.
NULL, BOOL, NUMBER, STRING, ARRAY, DOC, VECTOR = range(7)
I64_MIN, I64_MAX = -(2**63), 2**63 - 1
OPS = ("!=", "<", "<=", ">", ">=")


def rank_of(value: object) -> int:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, dict):
        return DOC
    return VECTOR if value and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value) else ARRAY


def rank_of_type(kind: T.DataType) -> int:
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, T.StringType):
        return STRING
    if isinstance(kind, T.ArrayType):
        return VECTOR if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else ARRAY
    if isinstance(kind, (T.StructType, T.MapType)):
        return DOC
    raise TypeError(f"{kind.simpleString()} is no value type; cast the column first")


class Field:
    """A column of a typed table with its type."""

    def __init__(self, name: str, kind: T.DataType):
        self.name, self.kind, self.rank = name, kind, rank_of_type(kind)
        self.is_float = isinstance(kind, (T.FloatType, T.DoubleType))
        self.col = F.col(f"`{name}`")
        if self.rank == NUMBER:
            self.col = self.col.cast("double" if self.is_float else "bigint")

    def _present(self, holds: bool) -> Column:
        return self.col.isNotNull() if holds else F.lit(False)

    def eq(self, value: object) -> Column:
        """Same variant and same value: 1 is not 1.0, and NaN equals nothing."""
        if rank_of(value) != self.rank or self.rank not in (BOOL, NUMBER, STRING):
            return F.lit(False)
        if self.rank == NUMBER and (isinstance(value, float) != self.is_float or value != value or not self.is_float and not I64_MIN <= value <= I64_MAX):
            return F.lit(False)
        return self.col == F.lit(value)

    def is_in(self, values: list) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | self.eq(v)
        return out

    def compare(self, op: str, value: object) -> Column:
        """op by the total order; != is its complement of equality in order, so an int 1 is not != 1.0."""
        if op not in OPS:
            raise ValueError(f"no comparison {op!r}")
        other = rank_of(value)
        if other != self.rank:
            return self._present(op == "!=" or (self.rank < other) == (op[0] == "<"))
        if self.rank == NUMBER:
            return self._compare_number(op, value)
        if self.rank not in (BOOL, STRING):
            raise TypeError(f"{self.name}: literals of this type compare in schemaless tables only")
        return _native(self.col, op, F.lit(value))

    def _compare_number(self, op: str, value: float) -> Column:
        if self.is_float:
            try:
                near = float(value)
            except OverflowError:
                near = math.copysign(math.inf, value)
            if value != value or near == value:
                return _native(self.col, op, F.lit(near))
            # No double lies between the literal and the double next to it.
            return {"!=": self._present(True), "<": self.col < near if near > value else self.col <= near, "<=": self.col < near if near > value else self.col <= near,
                    ">": self.col >= near if near > value else self.col > near, ">=": self.col >= near if near > value else self.col > near}[op]
        if value != value or value > I64_MAX:
            return self._present(op in ("!=", "<", "<="))
        if value < I64_MIN:
            return self._present(op in ("!=", ">", ">="))
        whole = math.floor(value)
        if whole == value:
            return _native(self.col, op, F.lit(int(whole)))
        return {"!=": self._present(True), "<": self.col <= whole, "<=": self.col <= whole, ">": self.col > whole, ">=": self.col > whole}[op]

    def between(self, low: object, high: object) -> Column:
        return self.compare(">=", low) & self.compare("<=", high)

    def order(self, descending: bool = False) -> Column:
        """Sort key with absent values lowest."""
        return self.col.desc_nulls_last() if descending else self.col.asc_nulls_first()


def _native(col: Column, op: str, value: Column) -> Column:
    return {"!=": col != value, "<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[op]


# ---- schemaless bodies ----

#: t: rank * 10, plus 1 for floats; k: sort key.
TAGGED = T.StructType([T.StructField("t", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("k", T.BinaryType())])
BODY = T.MapType(T.StringType(), TAGGED)


def _double_key(x: float) -> bytes:
    bits = struct.unpack(">Q", struct.pack(">d", x + 0.0))[0]
    return struct.pack(">Q", bits ^ (2**64 - 1 if bits >> 63 else 2**63))


def _number_key(x: float) -> bytes:
    """Order-preserving bits of the largest double at or below x, then what is left of an integer above it; NaN comes last."""
    if x != x:
        return b"\xff" * 16
    low = float(x)
    if isinstance(x, int) and low > x:
        low = math.nextafter(low, -math.inf)
    return _double_key(0.0 if low == 0 else low) + struct.pack(">Q", int(x) - int(low) if isinstance(x, int) else 0)


def sort_key(value: object) -> bytes:
    """A binary string; byte order of keys is the total order of values. Shorter sequences that are prefixes come first."""
    rank = rank_of(value)
    head = bytes([rank + 1])
    if rank == NULL:
        return head
    if rank == BOOL:
        return head + bytes([value])
    if rank == NUMBER:
        return head + _number_key(value)
    if rank == STRING:
        return head + value.encode().replace(b"\0", b"\0\xff") + b"\0\0"
    if rank == DOC:
        return head + b"".join(b"\x01" + sort_key(k) + sort_key(v) for k, v in sorted(value.items(), key=lambda e: e[0].encode())) + b"\0"
    return head + b"".join(b"\x01" + (_number_key(x) if rank == VECTOR else sort_key(x)) for x in value) + b"\0"


def tag(value: object) -> tuple[int, str | None, bytes]:
    return rank_of(value) * 10 + isinstance(value, float), value if isinstance(value, str) else None, sort_key(value)


def tag_body(body: dict) -> dict[str, tuple]:
    return {k: tag(v) for k, v in body.items()}


class DocField:
    """A key of a schemaless body column of type BODY."""

    def __init__(self, key: str, body: str = "body"):
        self.name, self.col = key, F.element_at(F.col(body), key)

    def eq(self, value: object) -> Column:
        t, _, k = tag(value)
        if value != value:
            return F.lit(False)
        return (self.col["t"] == t) & (self.col["k"] == F.lit(bytearray(k)))

    def is_in(self, values: list) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | self.eq(v)
        return out

    def compare(self, op: str, value: object) -> Column:
        return _native(self.col["k"], op, F.lit(bytearray(sort_key(value))))

    def between(self, low: object, high: object) -> Column:
        return self.compare(">=", low) & self.compare("<=", high)

    def order(self, descending: bool = False) -> Column:
        key = F.coalesce(self.col["k"], F.lit(bytearray(sort_key(None))))
        return key.desc() if descending else key.asc()
