"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is text with `*` (anything), `^` (a character that is not a letter, digit, `_`,
`-`, `.` or `%`, or the end), a leading `||` (start of a host or of one of its labels) and a
trailing `|` (the end). It is held against host + path. Each rule stands in the index under
that of its literal tokens which is rarest in the urls; a url's tokens fetch the candidates,
and only their regular expressions run. Rules without a whole literal token run on every url.

Up to MAX_RULES rules go to every worker. A larger table of rules is dealt by index token and
joined with the tokens of the distinct urls, so neither side is held in one place.

A list of rules is text, one rule a line: `block` or `allow`, a space, and a pattern. Empty
lines and lines that begin with `!` are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, staged

TOKEN = re.compile(r"[0-9a-zA-Z]+")
URL = re.compile(r"://([^/?#]*)([^?#]*)")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Rules that are sent to every worker; more of them are joined.
MAX_RULES = 200_000


@dataclass(frozen=True)
class UrlRule:
    """pattern; verdict: block or allow; name: set for rules that are reported and decide first."""

    pattern: str
    verdict: str
    name: str | None = None

    def regex(self) -> str:
        p, out = self.pattern, ""
        if p.startswith("||"):
            p, out = p[2:], r"^(?:[^/]*\.)?"
        end = p.endswith("|")
        for c in p[:-1] if end else p:
            out += {"*": ".*", "^": r"(?:[^0-9A-Za-z_\-.%]|$)"}.get(c) or re.escape(c)
        return out + "$" * end

    def tokens(self) -> list[str]:
        """Literal tokens that stand alone in every url that the rule fits."""
        p, anchored = (self.pattern[2:], True) if self.pattern.startswith("||") else (self.pattern, False)
        out = []
        for m in TOKEN.finditer(p):
            before = anchored if m.start() == 0 else p[m.start() - 1] != "*"
            after = m.end() < len(p) and p[m.end()] != "*"
            if before and after:
                out.append(m[0])
        return out


#: The rules of the contract, host and path.
NAMED = tuple(
    UrlRule(f"||{host}{path}", verdict, host + path)
    for verdict, host, path in (
        ("block", "com", "/en/"),
        ("allow", "example.com", "/en/7"),
        ("allow", "net", "/de/"),
        ("block", "example.net", "/de/8"),
        ("block", "org", "/es/"),
    )
)
#: Names of hosts, of parts of hosts and of folders that carry no documents.
HOSTS = (
    "ad ads adserver adservice adtrack affiliate affiliates analytics banner banners beacon beacons casino cheap-pills click clicks clickserver "
    "counter doubleclick escort escorts lottery metrics pagead payday pills pixel poker popunder popup popups promo spam spam-farm sponsor sponsors "
    "stat stats telemetry track tracker trackers tracking viagra warez xxx"
).split()
SUFFIXES = "casino escorts lottery payday pills poker replica-watches slots viagra warez xxx".split()
FOLDERS = "adclick adframe adimage adserver adserving ad-banner banner-ads beacon clickthrough click-track doorway link-farm linkfarm pagead popunder popup-ad sponsored-links tracking-pixel webbug".split()
PAGES = "about-ads ad-choices ads-policy advertising-policy privacy transparency".split()
#: The method's own patterns: 4 forms of these names. An allowing one beats the blocking ones.
PATTERNS = (
    *(UrlRule(f"||{w}.", "block") for w in HOSTS),
    *(UrlRule(f"-{w}.", "block") for w in SUFFIXES),
    *(UrlRule(f"/{w}/", "block") for w in FOLDERS),
    *(UrlRule(f"/{w}^", "allow") for w in PAGES),
)


def parse_rules(lines: Iterable[str]) -> Iterator[UrlRule]:
    """Rules of a list; a line that is none raises an error."""
    for line in lines:
        line = line.strip()
        if line and not line.startswith("!"):
            verdict, _, pattern = line.partition(" ")
            if verdict not in ("block", "allow") or not pattern.strip():
                raise ValueError(f"not a rule: {line!r}")
            yield UrlRule(pattern.strip(), verdict)


def read_rules(spark, path: str) -> DataFrame:
    """The rules of a list in text files, as a table (pattern, verdict, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(parse_rules(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([x.pattern for x in found], pa.string()), pa.array([x.verdict for x in found], pa.string()), pa.nulls(len(found), pa.string())], ["pattern", "verdict", "name"])

    return spark.read.text(path).mapInArrow(run, "pattern string, verdict string, name string")


def tokens_of(url: str | None) -> set[str]:
    return set(TOKEN.findall("".join(split_url(url))))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    m = URL.search(url) if url else None
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def token_counts(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """How many urls hold each wanted token (at most as many rows as the rules have tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for u in b.column(0).to_pylist():
                seen.update(tokens_of(u) & wanted)
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    counts = urls.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}


class Index:
    def __init__(self, rules: Iterable[UrlRule], counts: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            entry = (re.compile(r.regex(), re.S), r.name, r.verdict)
            tokens = r.tokens()
            if tokens:
                self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The longest named rule that fits decides; else any allowing pattern, any blocking one, allow."""
        whole, name, verdict, plain = host + path, None, None, set()
        if not whole:
            return None, "allow"
        for t in set(TOKEN.findall(whole)):
            for regex, own, decides in self.by_token.get(t, ()):
                if own is None and decides in plain or own is not None and name is not None and (len(own), own) <= (len(name), name):
                    continue
                if regex.search(whole):
                    if own is None:
                        plain.add(decides)
                    else:
                        name, verdict = own, decides
        for regex, own, decides in self.always:
            if (own is None or name is None or (len(own), own) > (len(name), name)) and regex.search(whole):
                if own is None:
                    plain.add(decides)
                else:
                    name, verdict = own, decides
        return name, verdict or ("block" if "block" in plain and "allow" not in plain else "allow")


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: Iterable[UrlRule] | DataFrame = NAMED + PATTERNS) -> DataFrame:
    """One row per input row: page_id, host, path, rule (name or null), verdict (block or allow).

    rules may be a table (pattern, verdict, name or null), as read_rules() gives. A null url, or
    one without `://`, has an empty host and path, no rule and is allowed. Of rules of one
    length the later name in code point order wins; equal rules count once. Repeated rows give
    repeated rows, an empty table an empty result; null ids are allowed, other columns ignored.
    Urls are taken whole, however long.
    """
    rows = pick(pages, page_id=page_id, url=url)
    if isinstance(rules, DataFrame):
        table = pick(rules, pattern="pattern", verdict="verdict", name="name").distinct()
        if table.count() > MAX_RULES:
            return joined_rules(rows, table)
        rules = [UrlRule(r["pattern"], r["verdict"], r["name"]) for r in table.collect()]  # at most MAX_RULES
    rules = tuple(rules)
    if len(rules) > MAX_RULES:
        table = rows.sparkSession.createDataFrame([(r.pattern, r.verdict, r.name) for r in rules], "pattern string, verdict string, name string")
        return joined_rules(rows, table.distinct())
    counts = token_counts(rows.select("url"), {t for r in rules for t in r.tokens()})
    kind = rows.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            found = [index.judge(*p) for p in parts]
            text = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *(pa.array(x, pa.string()) for x in text)], ["page_id", "host", "path", "rule", "verdict"]
            )

    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def joined_rules(rows: DataFrame, table: DataFrame) -> DataFrame:
    """filter_urls() by a join of the tokens of distinct urls with rules under their rarest token.

    A verdict depends on the url alone, so a url that very many rows have is judged once. Rules
    without a token, at most MAX_RULES, run on every url in the workers.
    """
    parts = "url string, host string, path string"
    compiled = "regex string, verdict string, name string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [split_url(u) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], ["url", "host", "path"])

    def compile_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rules = [UrlRule(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            columns = [[r.regex() for r in rules], [r.verdict for r in rules], [r.name for r in rules]]
            tokens = pa.array([r.tokens() for r in rules], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), tokens], ["regex", "verdict", "name", "tokens"])

    urls = staged(rows.select("url").where("url IS NOT NULL").distinct().mapInArrow(split, parts), "urls")
    rules = staged(table.select("pattern", "verdict", "name").mapInArrow(compile_, compiled + ", tokens array<string>"), "url-rules")
    words = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN.pattern), F.lit(0)))
    of_url = urls.select("url", "host", "path", F.explode(words).alias("token"))
    common = of_url.groupBy("token").agg(F.count("*").alias("n"))
    of_rule = rules.select("regex", "verdict", "name", F.explode("tokens").alias("token")).join(common, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    indexed = of_rule.groupBy("regex", "verdict", "name").agg(rarest)
    always = rules.where(F.size("tokens") == 0).select("regex", "verdict", "name").limit(MAX_RULES + 1).collect()
    if len(always) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules have no literal token to be found by")

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in ("url", "host", "path", "regex", "verdict", "name")}
            at = [i for i, (h, p, x) in enumerate(zip(columns["host"], columns["path"], columns["regex"])) if re.search(x, h + p, re.S)]
            yield pa.RecordBatch.from_arrays([pa.array([columns[c][i] for i in at], pa.string()) for c in ("url", "verdict", "name")], ["url", "verdict", "name"])

    def fitting_always(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [(re.compile(r["regex"], re.S), r["verdict"], r["name"]) for r in always]
        for b in batches:
            hits = [(u, v, n) for u, h, p in zip(*(b.column(c).to_pylist() for c in ("url", "host", "path"))) for x, v, n in tests if h + p and x.search(h + p)]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.string()) for k in range(3)], ["url", "verdict", "name"])

    fits = "url string, verdict string, name string"
    hits = of_url.join(indexed, "token").mapInArrow(fitting, fits)
    if always:
        hits = hits.unionAll(urls.mapInArrow(fitting_always, fits))
    named = F.max(F.when(F.col("name").isNotNull(), F.struct(F.length("name").alias("l"), "name", "verdict")))
    plain = lambda v: F.bool_or(F.col("name").isNull() & (F.col("verdict") == v))
    judged = hits.groupBy("url").agg(named.alias("r"), plain("block").alias("block"), plain("allow").alias("allow"))
    verdict = F.coalesce("r.verdict", F.when(F.col("block") & ~F.col("allow"), "block"), F.lit("allow"))
    known = urls.join(judged, "url", "left").select(F.col("url").alias("u"), "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"))
    out = rows.join(known, F.col("url") == F.col("u"), "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
