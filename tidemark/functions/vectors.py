"""Vector expressions over ``array<double>`` columns (H2-H4, A2, H1).

All arithmetic runs in the JVM with higher-order functions; inputs stored as
``array<float>`` are cast to double first so results match a double-precision
oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    prod = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(as_double_array(a), F.lit(0.0), lambda acc, x: acc + x * x)


def per_row(arr: Column, value: Column, fn) -> Column:
    """``transform(arr, x -> fn(x, value))`` with ``value`` evaluated once per row.

    A row-level expression used inside a lambda is re-evaluated for every
    element (O(d^2) for a norm); pairing the array with ``array_repeat`` of
    the value evaluates it once.
    """
    return F.zip_with(arr, F.array_repeat(value, F.size(arr)), fn)


def l2_normalize(a) -> Column:
    """A2: divide by the L2 norm (computed once per row); a zero vector stays zero."""
    arr = as_double_array(a)
    norm = F.sqrt(sq_norm(arr))
    return per_row(arr, F.when(norm > 0, norm).otherwise(F.lit(1.0)), lambda x, n: x / n)


def sq_l2_distance(a, b) -> Column:
    """H3: squared Euclidean distance (what a flat L2 index reports)."""
    diff = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a, b) -> Column:
    """H2: Euclidean distance."""
    return F.sqrt(sq_l2_distance(a, b))


def cosine_distance(a, b) -> Column:
    """H4: 1 - cos(a, b)."""
    # a zero vector has cosine 0 with everything
    cos = F.coalesce(F.try_divide(dot(a, b), F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))), F.lit(0.0))
    return F.lit(1.0) - cos


def half_cosine_distance(a, b) -> Column:
    """Audit distance (1 - cos) / 2 in [0, 1]."""
    return cosine_distance(a, b) / F.lit(2.0)


def hamming_fraction(a, b, bits: int = 64) -> Column:
    """H1: share of differing bits between two bigint signatures."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b))).cast("double") / F.lit(float(bits))


def hashed_bow(df, id_col: str, text_col: str, dims: int = 64):
    """Hashed bag of words: ``(id, embedding array<double>)`` of token counts in
    ``dims`` md5 buckets (tokens = lower-cased whitespace splits).

    Whole texts are tokenised. The tokens of a batch of rows are counted where
    they are, each different one hashed once, so only a vector per row is
    shuffled; rows that repeat an id are added up and each gets the sum. A
    null text and a null id give zeros.
    """
    from pyspark.sql import functions as Fn

    toks = df.select(Fn.col(id_col).alias("id"), Fn.lower(Fn.col(text_col)).cast("binary").alias("text"))
    kind = toks.schema["id"].dataType.simpleString()

    def count(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        class Buckets(dict):
            def __missing__(self, word):
                if len(self) >= 1 << 20:
                    self.clear()
                at = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % dims
                return at

        of = Buckets()
        for batch in batches:
            c = np.zeros((batch.num_rows, dims))
            for row, text in zip(c, batch.column("text")):
                if text.is_valid:   # bytes split at the white space of \\s, and leave no empty token
                    words = text.as_buffer().to_pybytes().split()
                    row[:] = np.bincount([of[w] for w in words], minlength=dims) if words else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(
                np.arange(0, c.size + 1, dims, dtype=np.int32), pa.array(c.ravel()))], ["id", "v"])

    sums = toks.mapInArrow(count, f"id {kind}, v array<double>").groupBy("id").agg(
        *[Fn.sum(Fn.col("v")[i]).alias(f"v{i}") for i in range(dims)], Fn.count(Fn.lit(1)).cast("int").alias("m"))
    vec = Fn.array(*[Fn.when(Fn.col("id").isNull(), 0.0).otherwise(Fn.col(f"v{i}")) for i in range(dims)])
    return sums.select("id", vec.alias("embedding"), Fn.explode(Fn.array_repeat(Fn.lit(0), Fn.col("m")))).select("id", "embedding")
