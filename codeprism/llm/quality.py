"""Quality rules as a short-circuit cascade, in Spark expressions only.

On a sample each rule is timed, and all verdicts are counted together. The order is greedy:
next comes the rule that rejects most of what the rules before it leave, per second. A rule's
counts stand inside its own branch of one CASE expression, so they are worked out only for
rows that no earlier rule rejects. The order never changes a verdict, only the work.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, drop_staged, let, pick, staged, whole, word_array

WINDOW = 5
#: Documents in the sample that costs and selectivities come from: about one in SAMPLE_ONE_IN,
#: by whole files where a table has MANY_FILES, so that the sample reads no others.
SAMPLE_ONE_IN, MANY_FILES = 64, 1024
#: Times that each rule is timed on the sample; the shortest counts.
TIMINGS = 2


def repeat_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more in the same text."""

    def covered(windows: Column) -> Column:
        sorted_windows = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(ws: Column) -> Column:
            twice = F.filter(
                ws,
                lambda w, i: F.coalesce(F.get(ws, i - 1)["h"] == w["h"], F.lit(False))
                | F.coalesce(F.get(ws, i + 1)["h"] == w["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda w: w["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        count = F.aggregate(
            let(sorted_windows, positions),
            start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        )["n"]
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(count)

    def windows(hs: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hs) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(WINDOW)]))

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: let(windows(hs), covered))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(found)


FIELDS = {
    "n_words": lambda t, ws, ls: F.size(ws),
    "word_chars": lambda t, ws, ls: F.char_length(F.regexp_replace(t, f"{SPACE}+", "")),
    "n_symbols": lambda t, ws, ls: F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
    "n_lines": lambda t, ws, ls: F.size(ls),
    "n_dup_lines": lambda t, ws, ls: F.size(ls) - F.size(F.array_distinct(ls)),
    "n_repeat_words": lambda t, ws, ls: repeat_words(ws),
    "n_same": lambda t, ws, ls: F.size(F.filter(ws, lambda w, i: w == F.get(ws, i - 1))),
    "n_upper": lambda t, ws, ls: F.regexp_count(t, F.lit(r"[A-ZÀ-ÖØ-Þ]")),
}
#: The counts that judge() returns for every row; all others are worked out by the rules that need them.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def parts_of(text: Column) -> list[Column]:
    """A text, its words and its lines with a word; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    return [text.alias("t"), word_array(text).alias("ws"), lines.alias("ls")]


def with_parts(text: Column, body) -> Column:
    """body of the parts of a text, each worked out once."""
    return let(F.struct(*parts_of(text)), lambda x: body(x["t"], x["ws"], x["ls"]))


@dataclass(frozen=True)
class Rule:
    """A rule that rejects a row by some of its counts."""

    name: str
    fields: tuple[str, ...]
    rejects: Callable[[Mapping[str, Column]], Column]


BASE = (
    Rule("few_words", ("n_words",), lambda s: s["n_words"] < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda s: s["n_repeat_words"] * 100 > s["n_words"] * 20),
)
#: The method's own rules.
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s: s["n_symbols"] * 10 > s["n_words"]),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda s: (s["n_dup_lines"] > 2) & (s["n_dup_lines"] * 10 > s["n_lines"] * 3)),
    Rule("word_length", ("word_chars", "n_words"), lambda s: (s["word_chars"] < s["n_words"] * 2) | (s["word_chars"] > s["n_words"] * 20)),
    Rule("same_word_again", ("n_same", "n_words"), lambda s: s["n_same"] * 2 > s["n_words"]),
    Rule("capitals", ("n_upper", "word_chars"), lambda s: s["n_upper"] * 2 > s["word_chars"]),
)


def rejects(rule: Rule, parts: tuple[Column, ...], known: Mapping[str, Column]) -> Column:
    """Whether a rule rejects a row; counts that are not known yet are worked out from its parts."""
    return rule.rejects({f: known[f] if f in known else FIELDS[f](*parts).cast("long") for f in rule.fields})


def cascade(rules: list[Rule], parts: tuple[Column, ...], known: Mapping[str, Column], first: Column | None = None) -> Column:
    """False from the first rule on that rejects a row (and where `first` holds), else true."""
    out = F.when(F.lit(False) if first is None else first, F.lit(False))
    for r in rules:
        out = out.when(rejects(r, parts, known), F.lit(False))
    return out.otherwise(F.lit(True))


def greedy(rules: tuple[Rule, ...], seconds: list[float], verdicts: list[tuple[tuple[bool, ...], int]]) -> list[Rule]:
    """Rules by rejections per second among the rows that earlier ones leave; then the cheap ones first.

    verdicts tells how many sampled rows have each combination of rejections. Without any the
    given order stays.
    """
    if not verdicts:
        return list(rules)
    left, open_, out = list(verdicts), list(range(len(rules))), []
    while open_:
        rate = {k: sum(n for v, n in left if v[k]) / seconds[k] for k in open_}
        best = max(open_, key=lambda k: (rate[k], -seconds[k]))
        out.append(rules[best])
        open_.remove(best)
        left = [(v, n) for v, n in left if not v[best]]
    return out


def sample_of(docs: DataFrame, text: str) -> DataFrame:
    """About one in SAMPLE_ONE_IN rows of docs: the column `text` alone, in no given order."""
    if len(docs.inputFiles()) >= MANY_FILES:
        try:  # a plain table of files: Spark then leaves out the other files before it reads any
            return pick(docs.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(SAMPLE_ONE_IN)) == 0), text=text)
        except AnalysisException:
            pass  # not a plain table
    rows = pick(docs, text=text)
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0)


def plan(docs: DataFrame, text: str, rules: tuple[Rule, ...], known: tuple[str, ...] = ()) -> list[Rule]:
    """Order rules by what they cost and reject on a sample of docs.

    Counts in `known` are worked out for every row anyway, so they cost a rule nothing. The
    sample is a table of texts, words, lines and those counts; a rule's time is that of a job
    that reads it and applies the rule, less that of one that only reads.
    """
    base = sample_of(docs, text).select(*parts_of(F.col("text")))
    counts = [FIELDS[f](F.col("t"), F.col("ws"), F.col("ls")).cast("long").alias(f) for f in known]
    sample = staged(base.select("*", *counts), "rule-sample")
    parts = (F.col("t"), F.col("ws"), F.col("ls"))
    each = [rejects(r, parts, {f: F.col(f) for f in known}) for r in rules]

    def seconds(column: Column) -> float:
        best = float("inf")
        for _ in range(TIMINGS):
            began = time.perf_counter()
            sample.agg(F.count_if(column)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    names = [f"r{i}" for i in range(len(rules))]
    found = sample.select(*[c.alias(n) for c, n in zip(each, names)]).groupBy(*names).count().collect()  # at most 2^rules rows
    if not found:
        drop_staged(sample)
        return list(rules)
    nothing = seconds((F.length("t") < 0) | (F.size("ws") < 0) | (F.size("ls") < 0))
    costs = [max(seconds(c) - nothing, nothing / 50) for c in each]
    drop_staged(sample)
    return greedy(rules, costs, [(tuple(r[n] for n in names), r["count"]) for r in found])


def base_failed(s: Mapping[str, Column]) -> Column:
    return BASE[0].rejects(s) | BASE[1].rejects(s)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict per row: doc_id, n_words .. n_repeat_words, base_failed, kept.

    One row per input row; repeated rows give repeated rows. A null or empty text has zero
    counts and fails the base verdict. Null ids are allowed. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = pick(docs, id=doc_id, text=text)
    order = plan(docs, text, rules, RETURNED)

    def row(*parts: Column) -> Column:
        counts = F.struct(*[FIELDS[f](*parts).cast("long").alias(f) for f in RETURNED])

        def judged(s: Column) -> Column:
            known = {f: s[f] for f in RETURNED}
            failed = base_failed(known)
            kept = cascade(order, parts, known, failed)
            return F.struct(*[known[f].alias(f) for f in RETURNED], failed.alias("base_failed"), kept.alias("kept"))

        return let(counts, judged)

    out = rows.select(F.col("id").alias("doc_id"), with_parts(F.col("text"), row).alias("s"))
    return out.select("doc_id", "s.*")


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns.

    The cascade of judge(), with the base rules among the others. Null and empty texts are
    rejected, repeated rows judged one by one, null ids and clashing names allowed; an empty
    table gives an empty result.
    """
    order = plan(docs, text, rules)
    plain, names, c = whole(docs, text=text)
    return plain.where(with_parts(c["text"], lambda *parts: cascade(order, parts, {}))).toDF(*names)
