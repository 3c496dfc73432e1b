"""Text functions: tokens of full-text search, query terms, features of names."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and private use: all else separates tokens.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
QUERY_TERM = r"(?U)[\w:]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def let(value: Column, body) -> Column:
    """Evaluate value once and pass it to body: columns used in lambdas may be worked out again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@functools.cache
def unaccented() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and those base letters."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), *unaccented())


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fold_python(text: str) -> str:
    return text.lower().translate(str.maketrans(*unaccented()))


def phrases(query: str) -> list[list[str]]:
    """The tokens of each term of a query: a term of several tokens is a phrase; one of none matches nothing."""
    out = []
    for term in re.findall(r"[\w:]+", query):
        folded = "".join(c if c.isalnum() or unicodedata.category(c) == "Co" else " " for c in fold_python(term))
        out.append(folded.split())
    return [p for p in out if p]


def feature_tokens(text: Column) -> Column:
    """Words of names and numbers, each with all its trigrams."""
    split = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])", " "))
    words = F.regexp_extract_all(split, F.lit(r"[A-Za-z_][A-Za-z0-9_]*|\d+"), F.lit(0))

    def grams(w: Column) -> Column:
        n = F.length(w)
        at = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
        found = F.when(n >= 3, F.transform(at, lambda i: F.substring(w, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(w), found)

    return F.flatten(F.transform(words, grams))


def token_estimate(text: Column) -> Column:
    """Tokens of a rendered text: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")
