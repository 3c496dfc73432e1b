"""Feature-hash embeddings, computed locally and deterministically."""

from __future__ import annotations

import hashlib
import math
import struct

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import feature_tokens

DIMENSIONS, LEAST, MAX_CHARS = 384, 16, 32_000


def embedding_text(*parts: Column) -> Column:
    """Non-empty parts, one a line, cut at MAX_CHARS characters."""
    kept = F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != "")
    return F.substring(F.array_join(kept, "\n"), 1, MAX_CHARS)


def hash_tokens(tokens, dimensions: int = DIMENSIONS) -> list[float]:
    """Each token adds, at four places given by its BLAKE2b, a signed weight that falls with its length."""
    out = [0.0] * dimensions
    for token in list(tokens) or ["<empty>"]:
        digest = hashlib.blake2b(token.encode(), digest_size=16).digest()
        weight = 1.0 / math.sqrt(max(1, len(token)))
        for i, word in enumerate(struct.unpack("<4I", digest)):
            out[word % dimensions] += weight if digest[4 * i] & 1 else -weight
    return out


def with_embedding(df: DataFrame, text: Column, name: str = "vector", dimensions: int = DIMENSIONS) -> DataFrame:
    """df with the embedding of a text as array<double>. The hash has no built-in, so this runs in Arrow batches."""
    if dimensions < LEAST:
        raise ValueError(f"an embedding has at least {LEAST} dimensions")
    rows, names = df.withColumn("_tokens", feature_tokens(text)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = pa.array([hash_tokens(t, dimensions) for t in b.column("_tokens").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), vectors], [*names, name])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def magnitude(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def is_valid(vector: Column) -> Column:
    """Not empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (magnitude(a) * magnitude(b))
