"""Packing, scoring, near-duplicates, mixing, WARC and top-k against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codeprism.llm import common, kdtree, lm, mixing, neardup, packing, quality, warc
from codeprism.operators import graph
from codeprism.operators.graph import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n", "one", "One, two; it's <|endoftext|> <|ENDOFTEXT|> x", "\u1100\u1161 e\u0301 \u0958 ΟΔΟΣ. \u0130x", "word! " * 3000, "\x1c\x85a\u00a0b\u2028c don't!!", "a" * 3000]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, f"s{i % 3}", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, TEXT string")


def test_packing_covers_every_id(spark):
    texts = ODD + [f"text number {i} " * (i % 40) for i in range(60)] + [ODD[3]] * 80
    rows = documents(spark, texts)
    got = packing.pack(rows.unionAll(rows.limit(3)), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            part = [r for r in pieces[i] if r["start"] == start]
            assert len(part) == (2 if i < 3 else 1)
            assert {(r["length"], r["ids_crc32"], r["doc_tokens"]) for r in part} == {(len(ids[start : start + 4096]), zlib.crc32(ids[start : start + 4096].tobytes()), len(ids))}
    for spans in fill.values():
        assert sum(n for _, n in spans) <= 4096
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
    assert packing.pack(rows.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_place_keeps_counts_and_capacity(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 30))}
    patterns = packing.place(histogram, 64)
    used = collections.Counter()
    for packs, runs in patterns:
        assert sum(length * times for length, times in runs) <= 64
        for length, times in runs:
            used[length] += packs * times
    assert used == histogram
    places = packing.Places(patterns)
    for length, n in histogram.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == n


def plain_scores(texts, tree):
    """The suffix tree with dictionaries."""
    toks = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    train = [i for i in range(len(texts)) if not lm.held_out(i)]
    uni = collections.Counter(w for i in train for w in toks[i])
    n, v = sum(uni.values()), len(uni)
    depths = range(1, tree.depth + 1)
    context = lambda ws, k, d: None if k < d - 1 else tuple([b"\n", *ws][k + 1 - d : k + 1])
    grams = {d: collections.Counter() for d in depths}
    for i in train:
        for k, w in enumerate(toks[i]):
            for d in depths:
                if (c := context(toks[i], k, d)) is not None:
                    grams[d][c, w] += 1
    stored = {0: {((), w): x for w, x in uni.items()}}
    seen = lambda c: stored[len(c) - 1].get((c[:-1], c[-1]), 0)
    for d in depths:  # next words seen twice or more, of contexts seen often enough, whose shorter n-gram was stored
        stored[d] = {(c, w): x for (c, w), x in grams[d].items() if x >= 2 and seen(c) >= tree.least and stored[d - 1].get((c[1:], w), 0) >= 2}
    root = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    rest = {}

    def p(c, w):
        if not c:
            return root(w)
        low = p(c[1:], w)
        if c not in rest:
            return low
        x = stored[len(c)].get((c, w), 0)
        return rest[c] * low + (max(x - tree.discount, 0) / seen(c) if x else 0)

    for d in depths:
        of = collections.defaultdict(dict)
        for (c, w), x in stored[d].items():
            of[c][w] = x
        for c, ws in of.items():
            if d > 1 and c[1:] not in rest:
                continue
            total = seen(c)
            r = max(1 - sum(x - tree.discount for x in ws.values()) / total, 1e-12)
            gain = sum(x * math.log((x - tree.discount) / total / p(c[1:], w)) for w, x in ws.items()) + (total - sum(ws.values())) * math.log(r)
            if gain >= tree.gain:
                rest[c] = r
    out = []
    for ws in toks:
        s = 0.0
        for k, w in enumerate(ws):
            c = next(c for d in range(tree.depth, 0, -1) if (c := context(ws, k, d)) is not None)
            while c and any(c[j:] not in rest for j in range(len(c))):
                c = c[1:]
            s += math.log10(p(c, w))
        out.append((len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10(root(w)) for w in ws), s))
    return out, collections.Counter(map(len, rest))


@pytest.mark.parametrize("tree", [lm.Tree(), lm.Tree(depth=2), lm.Tree(depth=5, least=3, gain=1.0), lm.Tree(depth=3, least=2)])
def test_scores_equal_a_plain_suffix_tree(spark, monkeypatch, tree):
    r = random.Random(3)
    phrases = ["the cat sat on the mat today", "on the mat", "a dog", "The", "a dog that sat on a cat", "rare%d"]
    texts = [None, "", "Alone"] + [" ".join(r.choice(phrases).replace("%d", str(r.randint(0, 30))) for _ in range(r.randint(1, 40))) for _ in range(120)]
    chance = collections.defaultdict(r.random)  # two words whose next depends on the last five
    for _ in range(150):
        ws = list("uvuvu")
        for _ in range(r.randint(1, 150)):
            ws.append("u" if r.random() < chance[tuple(ws[-5:])] else "v")
        texts.append(" ".join(ws))
    monkeypatch.setattr(lm, "CHUNK", 500)
    got = {x["doc_id"]: x for x in lm.score_documents(documents(spark, texts), tree=tree).collect()}
    expected, nodes = plain_scores(texts, tree)
    assert all(nodes[d] for d in range(1, tree.depth + 1))
    for i, (n, known, tokens, base, score) in enumerate(expected):
        x = got[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["held_out"]) == (n, known, tokens, lm.held_out(i))
        assert x["base_score"] == pytest.approx(base, rel=1e-9) and x["score"] == pytest.approx(score, rel=1e-4)
    held = [x for x in got.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_distinct_of_keys_that_share_their_high_bits():
    a, b = np.uint64(5 << 40), np.uint64((5 << 40) + 1)
    for keys in ([a, b, a, b, a], [b, a, b], [a] * 3, []):
        keys = np.array(keys * 1000, np.uint64) << np.uint64(20)
        own, place = common.distinct(keys)
        assert own.tolist() == sorted(set(keys.tolist())) and (not len(keys) or (own[place] == keys).all())
    r = np.random.default_rng(1)
    keys = r.integers(0, 300, 5000).astype(np.uint64)
    own, place = common.distinct(keys)
    assert (own == np.unique(keys)).all() and (own[place] == keys).all()
    assert (lm.from_key_planes(lm.key_planes(own)) == own).all()


def test_scores_of_empty_and_repeated_rows(spark):
    assert lm.score_documents(documents(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, None)], "doc_id long, text string")
    got = lm.score_documents(rows).collect()
    assert len(got) == 4 and sorted(x["n_tokens"] for x in got) == [1, 3, 3, 3]


def plain_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_texts():
    r = random.Random(5)
    texts = [None, "", "  ", "short one", "SHORT one", "a b c d", "a b c d e"]
    for _ in range(6):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([12, 60, 200]))]
        for _ in range(14):  # copies with ever more edits, so that groups are chains
            texts.append(" ".join(words))
            words = [f"e{r.randint(0, 999)}" if r.random() < 0.015 else w for w in words]
    return texts + [texts[8]] * 20


@pytest.mark.parametrize("block, family", [(2048, 1_000_000), (4, 300)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, family):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FAMILY", family)
    texts = near_texts()
    sizes, roots = plain_components(texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_edge_cases(spark):
    rows = spark.createDataFrame([(None, "p q r s t u"), (3, "p q r s t u"), (3, "p q r s t u"), (None, None), (5, "other words entirely here now")], "doc_id long, text string")
    got = neardup.near_duplicates(rows).collect()
    assert len(got) == 5
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, 3, False), (3, 3, True), (None, None, True), (5, 5, True)}
    assert neardup.near_duplicates(rows.limit(0)).count() == 0
    kept = neardup.deduplicate(rows).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [3, 5]


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (None, 4), (7, 9), (9, 8), (3, 1)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 141)}


def test_targets_by_water_filling():
    got = mixing.targets({"b": 100, "a": 10, None: 1000})
    assert got["a"] == 20 and got["b"] == 200 and got[None] == pytest.approx(1665 - 220)
    assert mixing.targets({"a": 0}) == {"a": 0.0}


def test_min_cost_flow_prefers_fewer_repetitions():
    patterns = {"ab": (["a", "b"], 100), "a": (["a"], 50)}
    flow = mixing.min_cost_flow(patterns, {"a": 60, "b": 80})
    assert sum(flow["ab"].values()) + sum(flow["a"].values()) == 140
    assert sum(flow["ab"].values()) <= 100 and flow["a"]["a"] <= 50  # nothing is taken twice
    assert flow["ab"]["b"] == 80 and flow["ab"]["a"] + flow["a"]["a"] == 60
    more = mixing.min_cost_flow(patterns, {"a": 400, "b": 0})
    assert sum(more["ab"].values()) == 200 and more["a"]["a"] == 100  # at most twice


def test_mixing_meets_targets(spark):
    r = random.Random(1)
    data = [(i, " ".join("w" * r.randint(1, 9) for _ in range(r.randint(0, 60))), r.choice(["x", "y", "z", "z", "z", None])) for i in range(900)]
    rows = spark.createDataFrame([*data, (None, None, "x")], "doc_id long, text string, source string")
    got = mixing.mix(rows).collect()
    assert len(got) == 901
    size = collections.Counter()
    for _, t, s in data:
        size[s] += len(t.split())
    wanted = mixing.targets(dict(size))
    for s in size:
        own = [x for x in got if x["source"] == s]
        assert {x["source_size"] for x in own} == {size[s]} and all(x["target"] == pytest.approx(wanted[s]) for x in own)
        assert abs(sum(x["taken"] for x in own) - wanted[s]) <= 15
        assert all(0 <= x["taken"] <= 2 * x["size"] for x in own)
    assert sorted(map(str, mixing.mix(rows.repartition(7)).collect())) == sorted(map(str, got))
    picked = mixing.sample(rows).groupBy("doc_id").count().collect()
    taken = {x["doc_id"]: x["taken"] // x["size"] for x in got if x["taken"]}
    assert {x["doc_id"]: x["count"] for x in picked} == taken
    assert mixing.mix(rows.limit(0)).count() == 0


def test_mixing_of_overlapping_sources(spark):
    rows = spark.createDataFrame([(i, "w " * 10, ["a", "b"] if i % 3 else ["a"]) for i in range(90)], "doc_id long, text string, source array<string>")
    got = mixing.mix(rows).collect()
    assert len(got) == 90 and sum(x["taken"] for x in got) == 1800  # the targets ask for more than twice all words


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>" + "x" * 2000 + "é</p>", "<b>" + "y" * 1500
    data = [(1, "http://a/ b\r\n", big), (5, None, big), (3, "u", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (4, "u", other), (4, "u", other), (None, "u", big)]
    rows = spark.createDataFrame([(*d, "z") for d in data], "page_id long, url string, html string, URL string")
    root, manifest = warc.write(rows, f"file://{tmp_path}/w", roll=900)
    got = sorted(map(tuple, warc.read(root, manifest).collect()), key=str)
    expected = []
    for i, _, h in data:
        b = (h or "").encode()
        top = max((x for x, _, y in data if y == h and x is not None), default=None)
        revisit = len(b) >= 1000 and i is not None and i != top
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(expected, key=str)
    assert manifest.count() > 1  # rolled
    again, manifest2 = warc.write(rows, f"file://{tmp_path}/w2", roll=900)
    files = sorted(r["file"] for r in manifest.collect())
    assert files == sorted(r["file"] for r in manifest2.collect())
    for f in files:
        assert (tmp_path / "w" / f).read_bytes() == (tmp_path / "w2" / f).read_bytes()
    empty, manifest3 = warc.write(rows.limit(0), f"file://{tmp_path}/w3")
    assert warc.read(empty, manifest3).count() == 0


def top_k(rows):
    got = collections.defaultdict(list)
    for h in kdtree.search(rows).collect():
        got[h["query_id"]].append((h["rank"], h["vec_id"], h["score"]))
    return {q: sorted(x) for q, x in got.items()}


def plain_top_k(data):
    """By all pairs of distinct rows, in whole numbers."""
    valid = {(i, tuple(v)) for i, v in data if i is not None and v and None not in v and all(map(math.isfinite, v))}
    whole = [(i, [int(max(min(math.floor(64 * x) if math.isfinite(64 * x) else 64 * x, 1.7976931348623157e308), -1.7976931348623157e308)) for x in v]) for i, v in valid]
    out = collections.defaultdict(list)
    for q, a in whole:
        if q % 20 == 0:
            for i, b in whole:
                if i != q and len(a) == len(b):
                    score = sum(x * y for x, y in zip(a, b))
                    out[q].append((-max(min(score, 2**63 - 1), -(2**63)), i))
    return {q: [(n, i, -s) for n, (s, i) in enumerate(sorted(x)[:20], 1)] for q, x in out.items()}


@pytest.mark.parametrize("seed, leaf, shard, stripe", [(0, 256, 1 << 18, 1 << 21), (1, 3, 1 << 18, 1 << 21), (2, 5, 120, 240), (3, 4, 300, 300)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, leaf, shard, stripe):
    for name, value in (("LEAF", leaf), ("SHARD", shard), ("STRIPE", stripe), ("GROUP", 8 if seed > 1 else 8192), ("BLOCK", 4 if seed > 1 else 512)):
        monkeypatch.setattr(kdtree, name, value)
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(260, 6)), 2)
    x[40:140] = x[40]  # one very common vector
    data = [(i, [float(v) for v in x[i]]) for i in range(260)] + [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (360, [1.0, 2.0]), (380, [3.0, 4.0]), (None, [1.0] * 6), (400, [])]
    rows = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, VEC_ID int")
    assert top_k(rows) == plain_top_k(data)
    assert kdtree.search(rows.limit(0)).count() == 0


def test_top_k_of_repeated_ids_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 12)
    monkeypatch.setattr(kdtree, "STRIPE", 24)
    data = [(20, [3.0, 4.5]), (7, [1.0, 0.0]), (7, [0.0, 9.0]), (7, [0.0, 9.0]), (40, [1e6, -1e6]), (41, [1e6, 1.25e6]), (60, [1e300, 1.0]), (61, [-1e308, 1e308]), (80, [1.0, 1.0]), (80, [2.0, 0.5]), (62, [1.7e308, 0.5])]
    data += [(i, [float(i % 7) * 1e5, -float(i)]) for i in range(100, 130)]
    got = top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert got == plain_top_k(data)
    few = top_k(spark.createDataFrame(data[:4], "vec_id long, embedding array<double>"))
    assert {(i, s) for _, i, s in few[20]} == {(7, 165888), (7, 12288)}


def test_kd_trees_leave_out_what_no_bound_reaches():
    r = np.random.default_rng(5)
    near = np.floor(64 * np.concatenate([r.normal(5, 0.1, (2000, 4)), r.normal(-5, 0.1, (6000, 4))]))
    forest = kdtree.Forest([kdtree.build(np.arange(a, a + 4000), near[a : a + 4000]) for a in (0, 4000)])
    found = list(forest.search(np.array([-1]), near[:1], 20, [kdtree.LEAST]))
    best = sorted(zip((-(near @ near[0])).astype(int).tolist(), range(8000)))[:20]
    assert [(i, -s) for s, i in best] == [(i, s) for _, i, s in found] and forest.visited < 4000


def test_word_table_splits_as_defined():
    texts = pa.array([None, "", " A\tb\x0bC  ", "é\u00a0x\x1cy", "Z"])
    offsets, places, words = common.word_table(texts)
    split = [[words[k].decode() for k in places[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert split == [[], [], ["a", "b", "c"], ["é\u00a0x\x1cy"], ["z"]]
    assert split == [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts.to_pylist()]


def test_pipeline_equals_its_stages_done_plainly(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    good = lambda: " ".join(f"{r.choice('abcdefgh')}word{r.randint(0, 300)}" for _ in range(60))
    texts = [good() for _ in range(40)] + ["| " * 30, "x " * 50, None]
    texts += texts[:5]
    rows = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good_ids = {x["doc_id"] for x in quality.judge(docs).collect() if x["kept"]}
    assert good_ids == set(range(40)) | set(range(43, 48))
    sizes, roots = plain_components([t if i in good_ids else None for i, t in enumerate(texts)])
    kept = {i for i in good_ids if roots[i] == i}
    stage = docs
    for name, f in corpus_pipeline.STAGES[:3]:
        stage = common.staged(f(spark, stage, str(tmp_path)), "test")
        assert stage.columns == docs.columns
        if name == "MinHash near-dedup":
            assert {x["doc_id"] for x in stage.collect()} == kept
    mixed = collections.Counter(x["doc_id"] for x in stage.collect())
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = sum(n * (len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in mixed.items())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(x["length"] for x in out) == expected and {x["doc_id"] for x in out} == set(mixed)


def test_warc_shards_of_outlying_and_very_large_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    r = random.Random(8)
    body = lambda i: f"<p>{i} " + "".join(r.choice("abcdefgh") for _ in range(900))
    data = [(i, f"u{i}", body(i)) for i in range(300)] + [(10**15, "far", body(0)), (-(2**63), "low", body(1)), (2**63 - 1, "high", body(2))]
    data += [(77, f"hot{i}", body(i) * 2) for i in range(150)] + [(None, "none", body(3))]
    big = "<b>" + "z" * 1200
    data += [(77, "copy", big), (78, "copy", big), (90, "copy", big)]
    rows = spark.createDataFrame(data, "page_id long, url string, html string")
    root, manifest = warc.write(rows, f"file://{tmp_path}/w")
    files = manifest.collect()
    assert sum(f["records"] for f in files) == len(data) and max(f["records"] for f in files) < 80
    ends = [r["page_id"] for r in warc.read(root, manifest).collect()]
    assert sorted(map(str, ends)) == sorted(str(i) for i, _, _ in data)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(root, manifest).where(f"payload_bytes = {len(big)}").collect()}
    assert got == {(77, "revisit", 90), (78, "revisit", 90), (90, "response", None)}
    again, manifest2 = warc.write(rows.repartition(5), f"file://{tmp_path}/w2")
    assert sorted(map(str, files)) == sorted(map(str, manifest2.collect()))


def test_mixing_of_null_arrays_repeated_rows_and_clashing_names(spark):
    data = [(i, "w " * 10, ["a"] if i % 2 else ["a", "b"], "x") for i in range(40)] + [(50, "w w", None, "x"), (51, "w w", [], "x"), (52, None, [None, "a"], "x")]
    rows = spark.createDataFrame(data + data[:3], "doc_id long, text string, source array<string>, SOURCE string")
    got = mixing.mix(rows).collect()
    assert len(got) == 46 and all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    assert {(x["doc_id"], x["taken"], x["source_size"]) for x in got if x["doc_id"] in (50, 51)} == {(50, 0, 0), (51, 0, 0)}
    twice = collections.Counter((x["doc_id"], x["taken"]) for x in got if x["doc_id"] < 3)
    assert set(twice.values()) == {2}  # repeated rows are taken together


def test_repeated_ids_keep_the_same_row_on_every_run(spark):
    rows = spark.createDataFrame([(3, f"text number {i % 4} " * 5, str(i)) for i in range(12)] + [(4, "other " * 9, "z")], "doc_id long, text string, note string")
    runs = [sorted(map(str, neardup.deduplicate(rows.repartition(n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2
    judged = [sorted(map(str, neardup.near_duplicates(rows.repartition(n)).collect())) for n in (1, 5)]
    assert judged[0] == judged[1]


def test_an_idle_worker_gives_up_its_memo(monkeypatch):
    import time

    monkeypatch.setattr(common, "IDLE", 0.3)
    common.forget_memo()
    memo = common.worker_memo("words", common.WordHash)
    memo[b"x"] = 1
    for _ in range(4):  # it stays as long as it is asked for
        time.sleep(0.15)
        assert common.worker_memo("words", common.WordHash) is memo
    time.sleep(1)
    assert not common._memos
    assert common.worker_memo("words", common.WordHash) is not memo
    common.forget_memo()


def test_packing_encodes_a_bounded_number_of_words_at_once():
    words = [f"{a}{b}{c}{end}" for a in "bcdfghklmn" for b in "aeiouyxzqw" for c in "rstvwxkpmnzqjl" for end in ("a", "e", "i", ".", "7")]
    ids, most = packing.WordIds(TOKENIZER), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            most.append(sum(len(t.split()) for t in texts))
            return plain.encode_batch_fast(texts, **options)

    plain, ids.tokenizer = ids.tokenizer, Counted()
    got = ids.ids([w.encode() for w in words])
    assert got == [np.array(plain.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert len(words) == 7000 and max(most) <= 4096
