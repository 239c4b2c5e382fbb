"""Ranges, combinations, permutations, products and primes as tables; infinite ones need a bound."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def int_range(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """(idx, val) of [start, stop), which may descend."""
    if step == 0:
        raise ValueError("step must not be 0")
    n = max(0, -(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("idx"), (F.lit(start) + F.col("id") * step).alias("val"))


def float_range(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    """start + idx * step within [start, stop)."""
    if not all(map(math.isfinite, (start, stop, step))) or step == 0:
        raise ValueError("finite ends and a step other than 0 are needed")
    n = max(0, math.ceil((stop - start) / step))
    return spark.range(n).select(F.col("id").alias("idx"), (F.lit(float(start)) + F.col("id") * float(step)).alias("val"))


def counter(spark: SparkSession, start: float, step: float, count: int) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("idx"), (F.lit(start) + F.col("id") * step).alias("val"))


def cycle(spark: SparkSession, items: Sequence, count: int) -> DataFrame:
    """The items over and over; none of none."""
    if not items:
        return spark.range(0).select(F.col("id").alias("idx"), F.col("id").alias("val"))
    return spark.range(count).select(F.col("id").alias("idx"), F.get(F.array(*(F.lit(x) for x in items)), (F.col("id") % len(items)).cast("int")).alias("val"))


def repeat(spark: SparkSession, item, count: int) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("idx"), F.lit(item).alias("val"))


def product(spark: SparkSession, dims: Sequence[int]) -> DataFrame:
    """(idx, val) of all index tuples, the last index fastest, by mixed radix: no join."""
    n = math.prod(dims)
    stride, parts = n, []
    for d in dims:
        stride = stride // d if d else 0
        parts.append((F.floor(F.col("id") / max(1, stride)) % d).cast("int") if d else F.lit(0))
    return spark.range(n).select(F.col("id").alias("idx"), F.array(*parts).alias("val"))


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of rows: the product itself is the result."""
    return a.crossJoin(b)


def combinations(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(idx, val) of the k-subsets of 0..n-1 in lexicographic order, each computed from its own rank."""
    if not 0 <= k <= n:
        raise ValueError("k must be within 0..n")

    def unrank(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf["id"]:
                left, pick, at = int(r), [], 0
                for slot in range(k, 0, -1):
                    while math.comb(n - at - 1, slot - 1) <= left:
                        left -= math.comb(n - at - 1, slot - 1)
                        at += 1
                    pick.append(at)
                    at += 1
                out.append(pick)
            yield pd.DataFrame({"idx": pdf["id"], "val": out})

    return spark.range(math.comb(n, k)).mapInPandas(unrank, "idx long, val array<int>")


def permutations(spark: SparkSession, n: int) -> DataFrame:
    """(idx, val) of the orders of 0..n-1, lexicographic, each from its own rank by factorial digits."""

    def unrank(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf["id"]:
                left, rest, pick = int(r), list(range(n)), []
                for i in range(n - 1, -1, -1):
                    d, left = divmod(left, math.factorial(i))
                    pick.append(rest.pop(d))
                out.append(pick)
            yield pd.DataFrame({"idx": pdf["id"], "val": out})

    return spark.range(math.factorial(n)).mapInPandas(unrank, "idx long, val array<int>")


def heap_permutations(items: Sequence) -> Iterator[list]:
    """Orders of items, each a swap from the one before (Heap's algorithm)."""
    a, count = list(items), [0] * len(items)
    yield list(a)
    i = 1
    while i < len(a):
        if count[i] < i:
            j = count[i] if i % 2 else 0
            a[i], a[j] = a[j], a[i]
            yield list(a)
            count[i] += 1
            i = 1
        else:
            count[i] = 0
            i += 1


def primes(spark: SparkSession, below: int, segment: int = 1 << 18) -> DataFrame:
    """Primes under a bound, one segment per row of work, sieved by the primes up to the root of the bound."""
    if below <= 1:
        raise ValueError("the bound must be above 1")
    import numpy as np

    root = math.isqrt(below) + 1
    small = np.ones(root + 1, bool)
    small[:2] = False
    for p in range(2, math.isqrt(root) + 1):
        if small[p]:
            small[p * p :: p] = False
    base = np.flatnonzero(small)

    def sieve(batches):
        import pandas as pd

        for pdf in batches:
            for s in pdf["id"]:
                low, high = int(s) * segment, min(below, (int(s) + 1) * segment)
                keep = np.ones(high - low, bool)
                keep[: max(0, 2 - low)] = False
                for p in base:
                    if p * p >= high:
                        break
                    first = max(p * p, -(-low // p) * p)
                    keep[first - low :: p] = False
                yield pd.DataFrame({"p": np.flatnonzero(keep) + low})

    return spark.range(-(-below // segment)).mapInPandas(sieve, "p long")


def items_permutations(items: Sequence) -> list[list]:
    return list(heap_permutations(items))


def items_product(a: Sequence, b: Sequence) -> list[tuple]:
    return list(itertools.product(a, b))
