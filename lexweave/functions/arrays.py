"""Operations on token arrays that stay in the JVM."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = "\u0000$"


def subarray_equal(a: Column, start: int | Column, end: int | Column, b: Column) -> Column:
    """a[start:end] = b, from 0."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.slice(a, start + 1, end - start) == b


def pad(a: Column, n: int | Column, token: str = PAD) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(a) >= n, a).otherwise(F.concat(a, F.array_repeat(F.lit(token), F.greatest(n - F.size(a), F.lit(0)))))


def choose(n: int, k: int) -> list[tuple[int, ...]]:
    return list(combinations(range(n), k))


def choose_up_to(n: int, k: int) -> list[tuple[int, ...]]:
    return [c for i in range(min(n, k) + 1) for c in combinations(range(n), i)]


def choose_by_size(n: int, k: int) -> dict[int, list[tuple[int, ...]]]:
    return {i: choose(n, i) for i in range(min(n, k) + 1)}


def subsequence(a: Column, places: Column) -> Column:
    """The elements at the places, from 0."""
    return F.transform(places, lambda i: F.get(a, i))


def subsequence_without(a: Column, places: Column) -> Column:
    return F.filter(a, lambda x, i: ~F.array_contains(places, i))


def lcs_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence, by rows of the usual table."""
    zero = F.transform(F.concat(F.array(F.lit("")), y), lambda _: F.lit(0))

    def row(old: Column, a: Column) -> Column:
        step = lambda new, j: F.array_append(
            new, F.greatest(F.get(old, j), F.element_at(new, -1), F.get(old, j - 1) + F.when(F.get(y, j - 1) == a, 1).otherwise(0))
        )
        return F.when(F.size(y) == 0, old).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(y), F.lit(1))), F.array(F.lit(0)), step))

    return F.element_at(F.aggregate(x, zero, row), -1)


def indel_distance(x: Column, y: Column, most: int | None = None) -> Column:
    """Insertions and deletions from x to y; with `most`, -1 where there are more, and lengths that differ by more are not compared."""
    d = F.size(x) + F.size(y) - 2 * lcs_length(x, y)
    return d if most is None else F.when(F.abs(F.size(x) - F.size(y)) > most, -1).otherwise(F.when(d <= most, d).otherwise(-1))


def compare(x: Column, y: Column) -> Column:
    """-1, 0 or 1: shorter records first, of equal length by tokens."""
    return F.when(F.size(x) != F.size(y), F.signum(F.size(x) - F.size(y))).otherwise(F.when(x < y, -1).when(x == y, 0).otherwise(1)).cast("int")


def edit_distance(x: Column, y: Column, most: int | None = None) -> Column:
    """Levenshtein distance of tokens: each token of the two becomes one character, and the built-in counts those.

    Characters start at U+10000, so the two arrays may have over a million distinct tokens. With `most`, only a band of the table is filled, and
    greater distances are -1.
    """
    names = F.array_distinct(F.concat(x, y))
    code = lambda a: F.array_join(F.transform(a, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, t) + 0x10000), 8, "0")), "UTF-32")), "")
    return F.levenshtein(code(x), code(y), most)


def jaccard(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def overlap(min1: Column, max1: Column, min2: Column, max2: Column) -> Column:
    return (min1 <= max2) & (max1 >= min2)


def union_sorted(*lists: Column) -> Column:
    """Sorted union without repeats."""
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def token_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def gram_prefixes(gram: Column) -> Column:
    """(token, depth) of a gram, the list form of a prefix trie."""
    return F.transform(gram, lambda t, i: F.struct(t.alias("token"), (i + 1).alias("depth"), F.slice(gram, 1, i + 1).alias("prefix")))


def log_histogram(df: DataFrame, column: str) -> DataFrame:
    """(bucket, n): counts by the whole part of log10; values below 1 are bucket -1."""
    c = F.col(column).cast("double")
    return df.groupBy(F.when(c >= 1, F.floor(F.log10(c))).otherwise(-1).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
