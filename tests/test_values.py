"""The total order: sort keys against exact comparison, typed predicates against Python."""

import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import BODY, DocField, Field, rank_of, sort_key, tag_body

numbers = st.one_of(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False), st.sampled_from([2**53, 2**53 + 1, float(2**53), 0, -0.0, 2**63 - 1, float(2**63)]))
scalars = st.one_of(st.none(), st.booleans(), numbers, st.text(max_size=4))


@given(numbers, numbers)
@settings(max_examples=500, deadline=None)
def test_number_keys_order_exactly(a, b):
    x, y = Fraction(a), Fraction(b)
    assert ((sort_key(a) > sort_key(b)) - (sort_key(a) < sort_key(b))) == (x > y) - (x < y)


@given(scalars, scalars)
@settings(max_examples=300, deadline=None)
def test_ranks_come_first(a, b):
    if rank_of(a) != rank_of(b):
        assert (sort_key(a) < sort_key(b)) == (rank_of(a) < rank_of(b))


def test_sequences_and_nan():
    assert sort_key("a") < sort_key("a\0") < sort_key("ab") < sort_key(["x"]) < sort_key({"k": 1}) < sort_key([1, 2])
    assert sort_key([1, 2]) < sort_key([1, 2, 0]) < sort_key([1, 3])
    assert sort_key(math.inf) < sort_key(math.nan) and sort_key(-math.nan) > sort_key(1e308)
    assert sort_key({"a": 1}) < sort_key({"a": 1, "b": 0}) < sort_key({"a": 2})


LITERALS = [None, True, 2, 2.5, 2.0, -1, 2**53 + 1, 2.0**53, 2**70, -(2**70), math.nan, math.inf, "a", {"k": 1}, ["a"]]


@pytest.mark.parametrize("kind, values", [("bigint", [None, -1, 2, 3, 2**53, 2**53 + 1, 2**63 - 1]), ("double", [None, -1.0, 2.0, 2.5, 2.0**53, math.inf, math.nan]), ("string", [None, "a", "b", ""])])
def test_typed_predicates_equal_the_order_of_keys(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    f = Field("x", df.schema["x"].dataType)
    made, want = [], []
    for lit in LITERALS:
        for op in ("!=", "<", "<=", ">", ">="):
            made.append(f.compare(op, lit).alias(f"c{len(made)}"))
            k = sort_key(lit)
            want.append([None if v is None else {"!=": sort_key(v) != k, "<": sort_key(v) < k, "<=": sort_key(v) <= k, ">": sort_key(v) > k, ">=": sort_key(v) >= k}[op] for v in values])
        made.append(f.eq(lit).alias(f"c{len(made)}"))
        want.append([None if v is None else type(v) is type(lit) and v == lit for v in values])
    got = df.select(*made).collect()
    for i, column in enumerate(want):
        for j, w in enumerate(column):
            assert bool(got[j][i]) == bool(w), (kind, values[j], i)


def test_schemaless_bodies(spark):
    bodies = [{"v": 1}, {"v": 1.0}, {"v": "1"}, {"v": None}, {}, {"v": [1, 2]}, {"v": ["a"]}, {"v": {"k": 2}}, {"v": True}]
    df = spark.createDataFrame([(i, tag_body(x)) for i, x in enumerate(bodies)], T.StructType().add("id", "integer").add("body", BODY))
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    v = DocField("v")
    assert ids(v.eq(1)) == [0] and ids(v.eq(1.0)) == [1] and ids(v.compare("!=", 1.0)) == [2, 3, 5, 6, 7, 8]
    assert ids(v.compare("<", 1)) == [3, 8] and ids(v.between(1, "1")) == [0, 1, 2] and ids(v.is_in([])) == []
    assert [r.id for r in df.orderBy(v.order(), F.col("id")).collect()] == [3, 4, 8, 0, 1, 2, 6, 7, 5]
