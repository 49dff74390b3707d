"""Column expressions over ``array<float|double>`` vectors. Arithmetic is in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(as_double(v), lambda x: x * x)))


def l2_normalise(v: Column) -> Column:
    """Unit-length form in double; the zero vector stays as it is."""
    scaled = lambda n: F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))
    return let(norm(v), scaled)


def round_vec(v: Column, digits: int = 10) -> Column:
    """Half-even rounding of every component."""
    return F.transform(as_double(v), lambda x: F.bround(x, digits))


def query_vector(v: Column, digits: int = 10) -> Column:
    return round_vec(l2_normalise(v), digits)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null where either side has no length."""
    return let(norm(a) * norm(b), lambda n: F.when(n != 0, dot(a, b) / n))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def distance(a: Column, b: Column, metric: str) -> Column:
    """l1, l2, l2sq, cosine (1-cos), ip (1-dot) or hamming (bits of packed longs)."""
    if metric == "hamming":
        bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc + x)
    if metric == "cosine":
        return 1.0 - cosine(a, b)
    if metric == "ip":
        return 1.0 - dot(a, b)
    gaps = F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)
    if metric == "l1":
        return total(F.transform(gaps, F.abs))
    squared = total(F.transform(gaps, lambda g: g * g))
    if metric == "l2sq":
        return squared
    if metric == "l2":
        return F.sqrt(squared)
    raise ValueError(f"unknown metric: {metric}")


def sign_bits(v: Column, dims: int) -> Column:
    """Sign pattern of a vector packed into longs, 32 components to a long."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda start: F.aggregate(
        F.transform(F.slice(v, start + 1, 32), bit), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    return F.array(*[word(start) for start in range(0, dims, 32)])


# --- text forms of a vector -------------------------------------------------


def to_payload(v: Column) -> Column:
    """``0|x0 1|x1 ...`` with the index starting at 0."""
    cells = F.transform(v, lambda x, i: F.concat(i.cast("string"), F.lit("|"), x.cast("string")))
    return F.array_join(cells, " ")


def from_payload(text: Column) -> Column:
    """Vector of a payload text, ordered by the index in the text; empty text gives an empty vector."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    cells = F.transform(
        tokens,
        lambda t: F.struct(
            F.substring_index(t, "|", 1).cast("int").alias("i"),
            F.substring_index(t, "|", -1).cast("double").alias("x"),
        ),
    )
    return F.transform(F.array_sort(cells), lambda c: c["x"])


def payload_map(text: Column, kind: str = "double") -> Column:
    """``token|payload`` text as a map; kind is float, double, int or string."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    cells = F.transform(
        tokens,
        lambda t: F.struct(
            F.substring_index(t, "|", 1).alias("key"),
            F.substring_index(t, "|", -1).cast(kind).alias("value"),
        ),
    )
    return F.map_from_entries(cells)


def to_csv(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def from_csv(text: Column) -> Column:
    return F.split(text, ",").cast("array<double>")
