"""Homomorphic multiset fingerprints of documents; DataFrame functions only.

A text is the multiset of its paragraphs (non-empty lines). Each paragraph hashes to a wide vector: WIDE lanes modulo 2**32 drawn from the whole
paragraph, which tell multisets apart, and SIGNS lanes modulo 2**32, the sums of +1 or -1 drawn from its clauses (split at
punctuation), whose cosine estimates how much two texts have in common. The fingerprint is the sum of the vectors, lane by
lane: the order of paragraphs doesn't matter, and a paragraph is added or removed by adding or subtracting its own
fingerprint.

Null and empty texts have no paragraphs and the zero fingerprint; equal fingerprints have likeness 1, a zero one and
another 0. Sums stay below 2**63 for any text that Spark can hold, so nothing overflows; very long texts are taken whole. A text
without punctuation is one clause a line. Empty tables give empty ones; columns named like a result are replaced, others stay.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free_name, text_of

WIDE, SIGNS = 8, 64
CLAUSE = r"[.,;:!?|\n]+"
LOW32 = 0xFFFFFFFF
PAIRED = 0x0000000100000001


def _sum(array: Column, part) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + part(x))


def _numbered(k: int):
    """The k-th hash function (a lambda with a default argument would be taken for one that wants the index)."""
    return lambda x: F.xxhash64(F.concat(F.lit(f"{k}:"), x))


def with_vector(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the vector of a text: an array of WIDE and one of SIGNS numbers, as a struct (wide, signs)."""
    # the hashes stand in columns of their own, so that each is made once
    para = [f"{name}_p{k}" for k in range(WIDE // 2)]
    paragraphs, clauses, counted = f"{name}_ps", f"{name}_cs", f"{name}_c"
    out = df.withColumn(paragraphs, F.filter(F.split(text, "\n"), lambda p: p != ""))
    out = out.withColumns({p: F.transform(paragraphs, _numbered(k)) for k, p in enumerate(para)} | {clauses: F.transform(F.filter(F.split(text, CLAUSE), lambda c: c != ""), lambda c: F.xxhash64(c))})
    wide = [_sum(F.col(p), lambda x, s=s: F.shiftrightunsigned(x, s).bitwiseAND(F.lit(LOW32))).bitwiseAND(F.lit(LOW32)) for p in para for s in (0, 32)]
    # two counts of one bits in each sum, 32 bits wide each
    out = out.withColumn(counted, F.array(*[_sum(F.col(clauses), lambda x, j=j: F.shiftrightunsigned(x, j).bitwiseAND(F.lit(PAIRED))) for j in range(SIGNS // 2)]))
    n = F.size(clauses)
    ones = F.concat(F.transform(counted, lambda c: c.bitwiseAND(F.lit(LOW32))), F.transform(counted, lambda c: F.shiftrightunsigned(c, 32)))
    signs = F.transform(ones, lambda c: _signed(2 * c - n))
    return out.withColumn(name, F.struct(F.array(*wide).alias("wide"), signs.alias("signs"))).drop(paragraphs, clauses, counted, *para)


def _signed(x: Column) -> Column:
    """x modulo 2**32, between -2**31 and 2**31 - 1."""
    return (F.pmod(x.cast("long") + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("int")


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW32)))
    signs = F.zip_with(a["signs"], b["signs"], lambda x, y: _signed(x.cast("long") + sign * y.cast("long")))
    return F.struct(wide.alias("wide"), signs.alias("signs"))


def inserted(vector: Column, paragraphs: Column) -> Column:
    """The vector of a text after paragraphs with the other vector were added to it."""
    return _lanewise(vector, paragraphs, 1)


def deleted(vector: Column, paragraphs: Column) -> Column:
    return _lanewise(vector, paragraphs, -1)


def hexed(vector: Column) -> Column:
    """The fingerprint as text: 8 hexadecimal digits for each wide lane, then 8 for each sign lane."""
    digits = lambda v, n: F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), n, "0"))
    return F.concat(F.array_join(digits(vector["wide"], 8), ""), F.array_join(digits(F.transform(vector["signs"], lambda x: F.pmod(x.cast("long"), F.lit(1 << 32))), 8), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two texts' multisets of clauses, 0 to 1; 1 exactly for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x["signs"], y["signs"], lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((a["wide"] == b["wide"]) & (a["signs"] == b["signs"]), F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def with_fingerprint(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """df with the fingerprint's text; a column of this name is replaced."""
    kept = dropped(df, name)
    return with_vector(kept, text_of(kept, text_col), f"{name}_v").withColumn(name, hexed(F.col(f"{name}_v"))).drop(f"{name}_v")


#: Bytes of carried text that a range should hold, rows of a range in the sample that its bounds come from, and the most ranges (bounds go into the plan).
RANGE_BYTES, SAMPLED, RANGES = 4 << 20, 20, 50_000


def _bounds(df: DataFrame, order: str, mark: str, size: Column) -> list:
    """Rows (order, mark) that ranges of about RANGE_BYTES begin with, in order; the first is the least of all."""
    whole = df.agg(F.min(F.struct(order, mark)).alias("low"), F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return []
    ranges = min(RANGES, max(1, whole["bytes"] // RANGE_BYTES), whole["n"])
    slots = 1 << 30
    chosen = df.where(F.pmod(F.xxhash64(order, mark), F.lit(slots)) < min(slots, slots * ranges * SAMPLED // whole["n"] + 1))
    # bounded: about SAMPLED rows a range
    rows = chosen.groupBy(order, mark).agg(F.sum(size).alias("bytes")).orderBy(F.asc_nulls_first(order), mark).collect() if ranges > 1 else []
    step, have, out = sum(r["bytes"] for r in rows) / ranges, 0, [(whole["low"][order], whole["low"][mark])]
    for r in rows:
        if have >= step * len(out) and (r[order], r[mark]) != out[-1]:
            out.append((r[order], r[mark]))
        have += r["bytes"]
    return out


def _rank_in(bounds: list, order: Column, mark: Column, kind: str) -> tuple[Column, Column]:
    """How many of the sorted bounds are at most (order, mark), by binary search, and whether the last of these is equal to it."""
    n = len(bounds)
    powers = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    orders, marks = F.array(*[F.lit(b[0]) for b in bounds]).cast(f"array<{kind}>"), F.lit([b[1] for b in bounds])

    def below(i: Column) -> Column:
        o, m = F.get(orders, i), F.get(marks, i)
        same = o.eqNullSafe(order) & (m <= mark)
        return same | F.when(o.isNull(), order.isNotNull()).otherwise(F.coalesce(o < order, F.lit(False)))

    at = F.aggregate(F.lit(powers), F.lit(0), lambda at, p: F.when((at + p <= n) & below(at + p - 1), at + p).otherwise(at))
    equal = lambda i: F.get(orders, i).eqNullSafe(order) & (F.get(marks, i) == mark)
    return at, equal


def with_next(df: DataFrame, order: str, carried: list[str], prefix: str = "next_") -> DataFrame:
    """df with the carried columns (the first a text) of the row that follows in ascending order; the last row is followed by the first.

    The order column may be of any type that has an order. Equal order values are ordered by a hash of the first carried column, then by the carried
    columns; null ones come first. Rows are dealt to ranges of about RANGE_BYTES, whose bounds are rows of a sample (only the work
    depends on it), so that also many rows of one order value, or of none, are dealt to many ranges; the first rows of each range
    also go to the range before, so that no window spans ranges and nothing is sorted in one place.
    """
    mark, home, copy, place = (free_name(df, x) for x in ("mark__", "home__", "copy__", "range__"))
    marked = df.withColumn(mark, F.xxhash64(carried[0]))
    bounds = _bounds(marked, order, mark, F.coalesce(F.octet_length(carried[0]), F.lit(0)) + 64)
    if not bounds:
        return df.withColumns({f"{prefix}{c}": F.col(c) for c in carried})
    at, equal = _rank_in(bounds, F.col(order), F.col(mark), df.schema[order].dataType.simpleString())
    # from 1; each bound is some row's
    homed = marked.withColumn(home, at)
    opens = equal(F.col(home) - 1)
    before = F.when(F.col(home) == 1, F.lit(len(bounds))).otherwise(F.col(home) - 1)
    both = homed.withColumn(copy, F.explode(F.when(opens, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both = both.withColumn(place, F.when(F.col(copy) == 1, before).otherwise(F.col(home)))
    window = Window.partitionBy(place).orderBy(copy, F.asc_nulls_first(order), mark, *[F.asc_nulls_first(c) for c in carried])
    led = both.withColumns({f"{prefix}{c}": F.lead(c).over(window) for c in carried})
    return led.where(F.col(copy) == 0).drop(mark, home, copy, place)


def edited_by_next(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_chars, edited, own, edited_vector, next_vector): each text, and it with its last half replaced by the next one's start."""
    base = df.select(F.col(id_col), text_of(df, text_col).alias("text"))
    base = with_vector(base, F.col("text"), "own")
    led = with_next(base, id_col, ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    led = led.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))})
    return with_vector(led.drop("text", "next_text"), F.col("edited"), "edited_v").withColumnRenamed("next_own", "next_v")


def union_vector(vectors: list[Column]) -> Column:
    return functools.reduce(inserted, vectors)
