"""HTTP connectors for embeddings and language models, and the report sink."""

from __future__ import annotations

import json
import math
import os
import re
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH, TIMEOUT, MAX_RESPONSE = 64, 60, 8 << 20


class ConnectorError(RuntimeError):
    """What went wrong, without addresses, keys or bodies."""


def post(url: str, body: dict, key: str | None = None, timeout: float = TIMEOUT) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            data = response.read(MAX_RESPONSE + 1)
    except Exception as error:
        raise ConnectorError(f"the provider failed: {type(error).__name__}") from None
    if len(data) > MAX_RESPONSE:
        raise ConnectorError("the provider's response is too large")
    try:
        return json.loads(data)
    except ValueError:
        raise ConnectorError("the provider's response is no JSON") from None


def vectors_of(response: dict, n: int) -> list[list[float]]:
    """Vectors in the order asked; their indexes must be 0 to n - 1, each once, and they must be finite and of one length."""
    rows = response.get("data") if isinstance(response, dict) else None
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows) or sorted(r.get("index", -1) for r in rows) != list(range(n)):
        raise ConnectorError("the provider's indexes do not match the request")
    try:
        out = [[float(x) for x in r["embedding"]] for r in sorted(rows, key=lambda r: r["index"])]
    except (KeyError, TypeError, ValueError):
        raise ConnectorError("the provider's vectors are no numbers") from None
    if any(not v or not all(map(math.isfinite, v)) for v in out) or len({len(v) for v in out}) > 1:
        raise ConnectorError("the provider's vectors are empty, not finite or of several lengths")
    return out


def embedding_endpoint(url: str, model: str, key: str | None = None, timeout: float = TIMEOUT) -> Callable[[list[str]], dict]:
    """An embeddings service: one request per batch of texts, no retries."""
    return lambda texts: post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": texts}, key, timeout)


def hosted_embeddings(df: DataFrame, text: str, call: Callable[[list[str]], dict], name: str = "vector") -> DataFrame:
    """df with the vectors that call returns for a text column, BATCH texts at a time, without retries."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                texts = [t or "" for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(vectors_of(call(texts), len(texts)), pa.list_(pa.float64()))], [*names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def chat(url: str, model: str, key: str | None = None) -> Callable[[str], str]:
    """A language model behind one completion request per prompt."""

    def complete(prompt: str) -> str:
        reply = post(f"{url.rstrip('/')}/chat/completions", {"model": model, "messages": [{"role": "user", "content": prompt}]}, key)
        try:
            return reply["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError):
            raise ConnectorError("the provider's response has no message") from None

    return complete


def scripted(*responses: str) -> Callable[[str], str]:
    """A test double that gives the responses in order and repeats the last."""
    left = list(responses)

    def complete(prompt: str) -> str:
        return left.pop(0) if len(left) > 1 else left[0]

    return complete


def write_report(path: str, report: dict) -> None:
    """JSON by a temporary file and a rename; absolute paths in it are refused."""

    def check(value) -> None:
        if isinstance(value, dict):
            for v in value.values():
                check(v)
        elif isinstance(value, list):
            for v in value:
                check(v)
        elif isinstance(value, str) and re.match(r"(/|[A-Za-z]:[\\/])", value):
            raise ValueError("a report holds no absolute paths")

    check(report)
    temp = f"{path}.{os.getpid()}.tmp"
    with open(temp, "w") as f:
        json.dump(report, f, indent=2, sort_keys=True)
    os.replace(temp, path)
