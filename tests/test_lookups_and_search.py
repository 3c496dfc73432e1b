import random
import hashlib
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from codeprism.operators.postings import Index
from codeprism.sources.staging import Manifests
from codeprism.functions import embedding, ids, text
from codeprism.operators import fusion, lookups, page, search

VARIANTS = "id string, symbol_id string, qualified_name string, signature string, documentation string, source_text string, is_definition boolean, translation_unit_id string, build_variant string"


def variants(spark, rows):
    return spark.createDataFrame([(f"v{i}", *r) for i, r in enumerate(rows)], VARIANTS)


ROWS = [
    ("s1", "parser::parse", "int parse(Stream)", "Parses input", "return größe;", True, "tu1", "alpha"),
    ("s1", "parser::parse", "int parse(Stream)", "", "parse parse parse", False, "tu2", "beta"),
    ("s2", "decode", "void decode()", "uses parser_state", "parser state machine", True, "tu1", "alpha"),
    ("s3", "parse", "", None, "x", False, "tu3", "beta"),
    ("s4", "other", "parse parse", "", "Ünïcode große", True, "tu1", "alpha"),
]


def fts(query, weights, columns=("",), rows=ROWS):
    """Scores of a full-text index of the standard library."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(qualified_name, signature, documentation, source_text, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, qualified_name, signature, documentation, source_text) VALUES (?,?,?,?,?)", [(i + 1, *r[1:5]) for i, r in enumerate(rows)])
    match = " OR ".join(f'{c}"{t}"' for t in query.split() for c in columns)
    found = db.execute(f"SELECT rowid, -bm25(t, {', '.join(map(str, weights))}) FROM t WHERE t MATCH ?", (match,))
    return {f"v{i - 1}": s for i, s in found}


@pytest.mark.parametrize("query", ["parse", "parser::parse", "parser_state grosse", "große größe", "parse decode machine", "unicode", ":: _", "missing"])
def test_bm25_equals_a_full_text_index(spark, query):
    found = search.bm25(variants(spark, ROWS), query, search.LEXICAL)
    got = {} if found is None else {r["id"]: r["score"] for r in found.collect()}
    expected = {} if not text.phrases(query) else fts(query, (8, 4, 2, 1))
    assert got == pytest.approx(expected)


def test_symbol_search_counts_each_column_and_adds_bonuses(spark):
    expected = fts("parse", (12, 6, 0, 0), ("qualified_name : ", "signature : "))
    got = [(r["id"], r["score"]) for r in search.symbol_search(variants(spark, ROWS), " Parse ").collect()]
    bonus = {"v0": 1.0, "v1": 1.0, "v3": 2.0}
    assert dict(got) == pytest.approx({i: s + bonus.get(i, 0) for i, s in expected.items()})
    assert [i for i, _ in got] == sorted(dict(got), key=lambda i: (-dict(got)[i], ROWS[int(i[1])][1], i))


def test_scope_drops_rows_after_scoring(spark):
    df = variants(spark, ROWS)
    every = {r["id"]: r["score"] for r in search.lexical_search(df, "parse").collect()}
    scoped = {r["id"]: r["score"] for r in search.lexical_search(df, "parse", ("beta",)).collect()}
    assert scoped == {i: every[i] for i in scoped} and set(scoped) == {"v1", "v3"}
    assert search.lexical_search(df, "::").count() == 0


def test_vector_search_and_validation(spark):
    rows = spark.createDataFrame([("a", "m", [1.0, 1.0], "b"), ("c", "m", [-1.0, 0.0], "b"), ("d", "other", [1.0], "b")], "variant_id string, model string, vector array<double>, build_variant string")
    got = [(r["variant_id"], r["score"]) for r in search.vector_search(rows, [2.0, 2.0], "m").collect()]
    assert [g[0] for g in got] == ["a", "c"] and got[0][1] == pytest.approx(1) and got[1][1] == pytest.approx(-1 / math.sqrt(2))
    for bad in ([], [0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            search.vector_search(rows, bad, "m")
    with pytest.raises(ValueError, match="dimensions"):
        search.vector_search(rows, [1.0, 2.0, 3.0], "m")
    odd = spark.createDataFrame([([1.0],), ([0.0],), ([],), (None,), ([float("inf")],)], "vector array<double>")
    assert search.valid_embeddings(odd).count() == 1


def test_feature_hash_embedding(spark):
    words = spark.createDataFrame([("parseHTTPStream_2 x",), ("",)], "t string")
    toks = [r[0] for r in words.select(text.feature_tokens(F.col("t"))).collect()]
    assert toks[0][0] == "parse" and "par" in toks[0] and toks[0][-1] == "x" and toks[1] == []
    got = [r["vector"] for r in embedding.with_embedding(words, F.col("t"), dimensions=16).collect()]
    assert got[0] == pytest.approx(embedding.hash_tokens(toks[0], 16)) and got[1] == pytest.approx(embedding.hash_tokens([], 16))
    assert any(got[1]) and len(got[0]) == 16
    with pytest.raises(ValueError):
        embedding.with_embedding(words, F.col("t"), dimensions=8)


def test_pages_are_bounded_and_say_so(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    assert {r["truncated"] for r in page.bounded_page(df, [F.col("n")], 9).collect()} == {True}
    exact = page.bounded_page(df, [F.desc("n")], 10).collect()
    assert [r["n"] for r in exact] == list(range(9, -1, -1)) and not exact[0]["truncated"]
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            page.bounded_page(df, [F.col("n")], bad)
    plan = page.bounded_page(df, [F.col("n")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scopes_are_checked():
    assert lookups.checked_scope(("a", "b", "a")) == ("a", "b")
    for bad in ((), ("a b",), tuple(map(str, range(17))), ("x" * 129,), ("",)):
        with pytest.raises(ValueError):
            lookups.checked_scope(bad)


def test_symbols_by_id(spark):
    df = variants(spark, ROWS)
    assert lookups.get_symbol(df, "s1").first()["id"] == "v0"
    assert lookups.get_symbol(df, "s1", ("beta",)).first()["id"] == "v1"
    assert lookups.get_symbol(df, "v1").first()["id"] == "v1"
    got = lookups.get_symbols(df, ["s1", "nope", "v1", "s1"]).orderBy("position").collect()
    assert [r["id"] for r in got] == ["v0", None, "v1", "v0"]


def test_evidence_page_puts_certain_then_nulls_first(spark):
    rows = [("e1", "a", "possible", "x", None, None), ("e2", "a", "certain", "x", "s", None), ("e3", "a", "certain", "x", None, "l")]
    df = spark.createDataFrame(rows, "id string, analysis_id string, certainty string, relation string, source_access_id string, source_location_id string")
    df = df.withColumn("target_access_id", F.lit(None).cast("string")).withColumn("target_location_id", F.lit(None).cast("string")).withColumn("build_variant", F.lit("b"))
    assert [r["id"] for r in lookups.page("data_flow_evidence", df, "a").collect()] == ["e3", "e2", "e1"]


def test_stable_ids(spark):
    got = spark.range(1).select(ids.stable_id("x", F.lit("é"), F.lit(7))).first()[0]
    assert got == ids.stable_id_python("x", "é", 7) == "x_" + hashlib.sha256("é\0007\0".encode()).hexdigest()[:32]


def test_fusion_counts_a_repeat_once_but_lets_it_take_a_rank(spark):
    ranked = spark.createDataFrame([("lexical", 1, "a"), ("lexical", 2, "a"), ("lexical", 3, "b"), ("symbol", 1, "b"), ("vector", 1, "c")], "backend string, rank int, key string")
    got = {r["key"]: r for r in fusion.fuse(ranked).collect()}
    assert got["a"]["score"] == pytest.approx(1 / 61) and got["b"]["score"] == pytest.approx(1 / 63 + 1.15 / 61) and got["c"]["score"] == pytest.approx(0.9 / 61)
    assert (got["b"]["first_backend"], got["b"]["first_rank"]) == (0, 3)


def test_the_only_project_is_chosen(spark):
    projects = spark.createDataFrame([("p1", "/a"), ("p2", "/b")], "id string, root string")
    assert lookups.project_of(projects, "/b") == "p2" and lookups.project_of(projects.limit(1)) == "p1"
    for bad in ((projects,), (projects, "/c"), (projects.limit(0),)):
        with pytest.raises(ValueError):
            lookups.project_of(*bad)


WORDS = ["parse", "the", "naïve", "file", "Parser", "größe", "tok_en", "a::b", "x1"]


def some_rows(spark, r, ids):
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    data = [(i, text(3), text(4), text(10) or None, text(60), r.choice(["b1", "b2"]), "s" + i) for i in ids]
    return spark.createDataFrame(data, "id string, qualified_name string, signature string, documentation string, source_text string, build_variant string, symbol_id string")


@pytest.mark.parametrize("query", ["parse", "the naive", "tok_en file", "a::b größe the the", "zzz", "zzz parse x1"])
def test_index_gives_the_scores_of_a_scan(spark, query, one_index):
    rows, index = one_index
    for weights, per_column in ((search.LEXICAL, False), (search.SYMBOL, True)):
        scan = {r["id"]: r["score"] for r in search.bm25(rows, query, weights, per_column=per_column).collect()}
        got = {r["id"]: r["score"] for r in index.scores(query, weights, per_column).collect()}
        assert got == {i: pytest.approx(s) for i, s in scan.items()}
    for f in (search.lexical_search, search.symbol_search):
        want = [(r["id"], pytest.approx(r["score"])) for r in f(rows, query, ("b1",), 7).collect()]
        assert [(r["id"], r["score"]) for r in f(rows, query, ("b1",), 7, index).collect()] == want
    assert index.scores("--- !", search.LEXICAL) is None


@pytest.fixture(scope="module")
def one_index(spark):
    """Rows, and an index that came to hold them by a change, a removal and a repeated change."""
    r = random.Random(4)
    old = some_rows(spark, r, [f"i{k}" for k in range(60)])
    new = some_rows(spark, r, [f"i{k}" for k in range(40, 90)])
    index = Index.create(old, tuple(search.LEXICAL))
    index.apply(some_rows(spark, r, ["i50", "i41"]))
    index.apply(new, spark.createDataFrame([("i3",), ("i4",), ("other",)], "id string"))
    rows = old.where("NOT id IN ('i3', 'i4')").join(new.select("id"), "id", "left_anti").unionByName(new)
    return rows, index


def test_index_statistics_and_compaction(spark, one_index):
    rows, index = one_index
    before = sorted(map(str, index.postings().collect()))
    state = index.state()
    assert state["rows"] == rows.count() == 88 and state["tokens"] == index.docs().agg({"d": "sum"}).first()[0]
    index.compact()
    assert len(index.state()["segments"]) == 1 and sorted(map(str, index.postings().collect())) == before
    empty = Index.create(rows.limit(0), tuple(search.LEXICAL))
    assert empty.scores("parse", search.LEXICAL).count() == 0


def test_index_reads_the_folders_of_its_terms_only(spark, one_index):
    plan = one_index[1].postings(["parse"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "(bucket#" in plan
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1][:60]


def test_hits_are_filled_up_with_standalone_symbols(spark):
    variants = spark.createDataFrame([("v1", "s1", "alpha", "", "", "", "b"), ("v2", "s2", "alpha beta", "", "", "", "b")], "id string, symbol_id string, qualified_name string, signature string, documentation string, source_text string, build_variant string")
    symbols = spark.createDataFrame([("s1", "alpha"), ("s3", "alpha three"), ("s4", "alpha"), ("s5", "other")], "id string, qualified_name string")
    got = [r["id"] for r in search.hits_with_standalone(variants, symbols, "alpha", 3).orderBy("position").collect()]
    assert got[:2] == ["v1", "v2"] and got[2:] == ["s4"]
    assert [r["id"] for r in search.hits_with_standalone(variants, symbols, "alpha", 1).collect()] == ["v1"]


def test_manifests_take_each_number_once(spark, tmp_path):
    a, b = Manifests(spark, f"file://{tmp_path}/m"), Manifests(spark, f"file://{tmp_path}/m")
    assert a.latest() == (0, None)
    a.commit(1, {"x": 1})
    a.commit(2, {"x": "é"})
    with pytest.raises(RuntimeError):
        b.commit(2, {"x": 3})
    assert b.latest() == (2, {"x": "é"})
