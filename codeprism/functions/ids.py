"""Stable ids and folded hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and half of the SHA-256 of the parts, each ended by a zero byte."""
    data = F.concat(*[x for p in parts for x in (F.encode(p.cast("string"), "UTF-8"), F.unhex(F.lit("00")))])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(data, 256), 1, 32))


def stable_id_python(prefix: str, *parts: object) -> str:
    data = b"".join(str(p).encode() + b"\0" for p in parts)
    return f"{prefix}_{hashlib.sha256(data).hexdigest()[:32]}"


def folded_hash(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """One hash per group of its rows in sorted order."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\x1e"), 256).alias("hash"))


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
