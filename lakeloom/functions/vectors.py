"""Column functions over vectors (array<double> or array<float>), all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalized(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps of counts; 0 if one is empty."""
    shared = F.filter(F.map_keys(a), lambda k: F.map_contains_key(b, k))
    total_of = lambda m: F.sqrt(total(F.transform(F.map_values(m), lambda x: x.cast("double") * x)))
    n = total_of(a) * total_of(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(total(F.transform(shared, lambda k: F.try_element_at(a, k).cast("double") * F.try_element_at(b, k))) / n)


def truncated(v: Column, size: int) -> Column:
    return F.slice(v, 1, size)


def quantized_int8(v: Column) -> Column:
    """``scale, q``: components times 127 / largest size, rounded half to even."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top == 0, F.lit(1.0)).otherwise(top / 127)
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.bround(x.cast("double") / scale).cast("int")).alias("q"))


def quantized_uint8(v: Column) -> Column:
    """``scale, zero, q``: components mapped from their range onto 0 to 255."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = F.when(high == low, F.lit(1.0)).otherwise((high - low) / 255)
    return F.struct(scale.alias("scale"), low.alias("zero"), F.transform(v, lambda x: F.bround((x.cast("double") - low) / scale).cast("int")).alias("q"))


def quantized_bits(v: Column) -> Column:
    """Signs, eight to a byte, the first in the lowest bit."""
    bits = F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(0))
    starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 8).cast("int"))
    return F.transform(starts, lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, k: s + F.shiftleft(F.lit(1), 0) * F.coalesce(F.get(bits, i * 8 + k), F.lit(0)) * F.pow(F.lit(2), k).cast("int")))


def dequantized(q: Column, scale: Column, zero: Column | None = None) -> Column:
    return F.transform(q, lambda x: x * scale + (F.lit(0.0) if zero is None else zero))


def softmax(v: Column) -> Column:
    """Shares of the exponentials, shifted by the largest component."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def argmax(v: Column) -> Column:
    """1-based place of the largest component, the first of several."""
    return F.array_position(v, F.array_max(v))


def activation(x: Column, kind: str, alpha: float = 0.01) -> Column:
    """sigmoid, tanh, relu, leaky, softplus or linear."""
    kinds = {
        "sigmoid": F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x))),
        "tanh": F.tanh(x),
        "relu": F.greatest(x, F.lit(0.0)),
        "leaky": F.when(x >= 0, x).otherwise(x * alpha),
        "softplus": F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
        "linear": x,
    }
    return kinds[kind]


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements by all elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements by those of the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def ratio(a: Column, b: Column, floor: float = 1e-6) -> Column:
    """One minus the difference by the larger size."""
    return 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def decay(age: Column, half_life: float) -> Column:
    """What is left of a weight after an age."""
    return F.pow(F.lit(0.5), age / half_life)
