"""Quality rules, chat formatting, URL filters and HTML extraction against plain Python."""

import hashlib
import random
import re
from html.parser import HTMLParser

import pytest

from codeprism.llm import chat, html, quality, urls

TEXTS = [None, "", "   \n\t ", "one", "a b c d e a b c d e a b c d e", "x\ny\nx\nx\n\ny", "## $ % | <> & *", "é " * 12, "the same words here again " * 9, "Ω\u00a0x y " * 400 + "end"]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (4, TEXTS[4], 1)], "doc_id long, text string, TEXT int")
    got = quality.judge(rows).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            n, chars, symbols, dup, repeat = plain_counts(TEXTS[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
            assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
            assert not (r["base_failed"] and r["kept"]) and r["kept"] is not None


def test_quality_keep_agrees_with_judge(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, good, good.upper(), "| " + " | ".join(good.split())])], "doc_id long, text string, Text string")
    kept = {r["doc_id"] for r in quality.judge(rows).collect() if r["kept"]}
    out = quality.keep(rows)
    assert out.columns == rows.columns and {r[0] for r in out.collect()} == kept == {len(TEXTS)}
    assert quality.judge(rows.limit(0)).count() == 0


def test_rule_order_is_by_rejections_per_second_of_what_is_left():
    a, b, c = quality.RULES[:3]
    verdicts = [((True, True, False), 60), ((True, False, False), 10), ((False, False, True), 20), ((False, False, False), 100)]
    assert quality.greedy((a, b, c), [1.0, 1.0, 1.0], verdicts) == [a, c, b]  # alone b rejects most after a, but nothing that a leaves
    assert quality.greedy((a, b, c), [9.0, 1.0, 1.0], verdicts) == [b, c, a]
    assert quality.greedy((a, b, c), [3.0, 2.0, 1.0], [((False,) * 3, 5)]) == [c, b, a]
    assert quality.greedy((a, b, c), [3.0, 2.0, 1.0], []) == [a, b, c]


def test_rule_plan_keeps_verdicts_and_own_counts_stand_in_their_branches(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ONE_IN", 1)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS * 5)], "doc_id long, text string, Text string")
    order = quality.plan(rows, "text", quality.RULES, quality.RETURNED)
    assert set(order) == set(quality.RULES)
    expected = sorted(map(str, quality.judge(rows).collect()))
    for rules in (quality.RULES, quality.RULES[::-1]):
        assert sorted(map(str, quality.judge(rows, rules=rules).collect())) == expected
    plan = quality.judge(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("À-ÖØ-Þ") == 1 and plan.index("CASE WHEN") < plan.index("À-ÖØ-Þ")
    assert "python" not in quality.judge(rows)._jdf.queryExecution().executedPlan().toString().lower()


def test_rule_sample_of_many_files_reads_only_some(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(quality, "MANY_FILES", 8)
    monkeypatch.setattr(quality, "SAMPLE_ONE_IN", 4)
    spark.range(400).selectExpr("id AS doc_id", "concat('some text ', id) AS text").repartition(20).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    sample = quality.sample_of(docs, "text")
    assert 0 < sample.count() < 300
    scan = sample._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in scan or "file_path" in scan
    assert quality.judge(docs).count() == 400 and quality.judge(docs.where("doc_id < 7")).count() == 7


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "a</s><t>b"), (1, 3, "assistant", "c<\\"), (1, 4, "user", None), (1, 5, None, "x"),
    (2, 7, "assistant", "first"), (2, 3, "system", "<c>"), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (None, 1, "user", "n"), (4, None, "user", "y" * 5000),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, Role string")
    formatted = chat.format_conversations(rows)
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    full = {r["conv_id"]: r for r in formatted.collect()}
    for conv in {t[0] for t in TURNS}:
        turns = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        trained = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == len(trained) and r["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
        assert "".join(s["piece"] for s in full[conv]["segments"]) == full[conv]["formatted"]
        assert r["formatted_chars"] == len(full[conv]["formatted"])
    assert full[1]["formatted"].count("<s>") == 4  # neighbours of one role share a block
    assert chat.digest(chat.format_conversations(rows.limit(0))).count() == 0


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.example.com/en/71?x", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://Example.COM/en/6", "example.com", "/en/6", "com/en/", "block"),
        ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("x://example.net/de/80#f", "example.net", "/de/80", "example.net/de/8", "block"),
        ("x://a.org/es/", "a.org", "/es/", "org/es/", "block"),
        ("x://a.org/es", "a.org", "/es", None, "allow"),
        ("x://www.cheap-pills.example.com/fr/1", "www.cheap-pills.example.com", "/fr/1", None, "block"),
        ("x://y?q://com/en/", "y", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://b.com/EN/a", "b.com", "/EN/a", None, "allow"),
    ],
)
def test_url_rules(url, host, path, rule, verdict):
    index = urls.Index(urls.NAMED + urls.PATTERNS, {})
    assert urls.split_url(url) == (host, path)
    assert index.judge(host, path) == (rule, verdict)


def test_url_index_equals_trying_every_rule(spark):
    rules = urls.NAMED + urls.PATTERNS + (urls.UrlRule("*pop*", "block"), urls.UrlRule("/shop^", "allow"))
    every = [f"http://{h}/{p}" for h in ("a.com", "example.com", "x.net", "ads.example.net", "spam-farm.org") for p in ("en/7", "en/", "de/8x", "es/", "pop/up", "shop", "shop/pop", "")] + [None, "x"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(every)] + [(0, every[0])], "page_id long, url string")
    got = urls.filter_urls(rows, rules=rules).collect()
    assert len(got) == len(every) + 1
    for r in got:
        whole = r["host"] + r["path"]
        fits = [x for x in rules if whole and re.search(x.regex(), whole, re.S)]
        named = max((x for x in fits if x.name), key=lambda x: (len(x.name), x.name), default=None)
        plain = {x.verdict for x in fits if not x.name}
        expected = named.verdict if named else "block" if plain == {"block"} else "allow"
        assert (r["rule"], r["verdict"]) == (named.name if named else None, expected)
    assert urls.filter_urls(rows.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body><nav><ul><li>Menu</li></ul></nav>
<header>Site</header><div class="ad">Buy</div><article><h1>Head&amp;line</h1><p>One  <b>t</b>wo
three<br>four<p>Five &lt;six&gt;<script>var x="</p>";</script></p><aside>related</aside><form>mail</form><p>Last&nbsp;one</p></article>
<section id="comments"><article>First!</article></section><footer>&copy;</footer></body>"""


def test_html_extraction(spark):
    assert html.main_text(PAGE) == "Head&line\n\nOne two three four\n\nFive <six>\n\nLast one"
    long = "<div><p>" + "word " * 60 + "</p><p>and more of it</p></div>"
    assert html.main_text(f"<ul><li>a</li><li>b</li></ul>{long}<div class='cookie-notice'>ok</div>").startswith("word word")
    assert html.main_text("<p>tiny</p>") == "tiny" and html.main_text(None) == "" and html.main_text("<script>x") == ""
    assert html.main_text("<nav>unclosed <article><p>kept</p></article>") == "kept"
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, HTML string")
    got = html.extract(rows).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(rows.limit(0)).count() == 0


def test_html_without_article_keeps_short_headings_short_sections_and_open_heads():
    long, menu = "word " * 60, "<nav>a</nav><nav>b</nav><nav>c</nav>"
    assert html.main_text(f"<h1>Rain</h1><p>{long}</p>") == f"Rain\n\n{long.strip()}"
    assert html.main_text(f"<p>{long * 17}</p>{menu}<h2>End</h2><p>{long * 3}</p>").endswith(f"\n\nEnd\n\n{(long * 3).strip()}")
    for head in ("<head><title>T</title><meta name=x><script>'<div>'</script>", "<head id=header><style>p{}</style>", "<head><title>T</title></head>"):
        assert html.main_text(f"<html>{head}<body><h1>Rain</h1><p>{long}</p>") == f"Rain\n\n{long.strip()}"
        assert html.main_text(f"<html>{head}<p>{long}</p>") == long.strip()


class PlainLines(HTMLParser):
    """Lines of well-formed pages: text, chrome, in an article, in a list, heading, characters in links."""

    CHROME = ({"nav", "header", "footer", "aside", "form"}, {"ad", "cookie", "comments"})

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.open, self.run, self.linked = [], [], "", 0
        self.feed(page)
        self.close()
        self.cut()

    def inside(self, *tags):
        return any(t in tags for t, _ in self.open)

    def cut(self):
        if text := " ".join(self.run.split()):
            chrome = any(t in self.CHROME[0] or c in self.CHROME[1] for t, c in self.open)
            self.lines.append([text, chrome, self.inside("article", "main"), self.inside("li"), self.inside("h1", "h2"), self.linked])
        self.run, self.linked = "", 0

    def edge(self, tag):
        if tag not in ("a", "b", "script"):
            self.cut()
        if tag in ("article", "main"):
            self.lines += [["", False, False, False, False, 0]] * html.WINDOW

    def handle_starttag(self, tag, attrs):
        self.edge(tag)
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in ("article", "main"):
            self.edge(tag)
            self.open.pop()
        else:
            self.cut()
            self.open.pop()
            self.edge(tag)

    def handle_data(self, data):
        if not self.inside("script", "style"):
            self.run += data
            self.linked += len(data) * self.inside("a")


def plain_main_text(page):
    lines = PlainLines(page).lines
    has = any(main and not chrome for _, chrome, main, *_ in lines)
    mass = []
    for text, chrome, main, item, _, linked in lines:
        if chrome or not text or not main and item and len(text) <= 20:
            mass.append(0)
        elif main:
            mass.append(len(text) + 80)
        else:
            mass.append(max(len(text) - linked, 0) / (8 if has else 1))
    window = [sum(mass[i : i + 3]) for i in range(len(mass))]
    surge = min(80, max(window, default=0))
    keep = set()
    for i, (s, m) in enumerate(zip(window, mass)):
        if s >= surge and m:
            dive = next((j for j in range(i, len(mass)) if not window[j]), len(mass))
            rise = next((j + 1 for j in range(i, -1, -1) if not window[j]), 0)
            keep |= set(range(i, dive)) | set(range(next((j for j in range(rise, i) if lines[j][4] and mass[j]), i), dive))
    return "\n\n".join(x[0] for i, x in enumerate(lines) if i in keep and x[0] and not x[1])


def random_page(r):
    def words(most):
        return " ".join(r.choice(["rain", "caf&eacute;", "&lt;p&gt;", "on", "weather\n", "<b>bold</b>", "a&nbsp;b"]) for _ in range(r.randint(1, most)))

    def block():
        return r.choice(["<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<p><a href='x'>{}</a></p>", "<p class='ad'>{}</p>", "<script>{}</script>"]).format(words(r.choice([2, 6, 60])))

    def chrome():
        return r.choice(["<nav><ul><li>{}</li><li>x</li></ul></nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<div class='cookie'>{}</div>", "<form>{}</form>"]).format(words(5))

    parts = [r.choice([block, chrome])() for _ in range(r.randint(0, 12))]
    if r.random() < 0.5:
        parts.insert(r.randint(0, len(parts)), "<article>" + "".join(r.choice([block, block, chrome])() for _ in range(r.randint(0, 8))) + "</article>")
    return "<html><body>" + "\n".join(parts) + "</body></html>"


def test_html_equals_a_plain_version_on_random_pages():
    r = random.Random(11)
    kept = dropped = 0
    for _ in range(1500):
        page = random_page(r)
        assert html.main_text(page) == plain_main_text(page), page
        lines = [x for x in html.lines_of(page) if x.text and not x.chrome]
        n = len(html.main_text(page).split("\n\n")) if lines else 0
        kept, dropped = kept + n, dropped + len(lines) - n
    assert kept > 2000 and dropped > 300  # the window sums leave out what is no chrome, too


def test_html_window_sums_find_the_article_without_its_tags():
    long = "word " * 60
    page = f"<nav><a href=x>a</a></nav><div class=ad>Buy this</div><article><h1>Rain</h1><p>{long}</p><p>Yes.</p></article><footer>f</footer>"
    assert html.main_text(page) == html.main_text(re.sub("</?article>", "", page)) == f"Rain\n\n{long.strip()}\n\nYes."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><article><p>x y</p>", "x y"),
        ("<article><p>a</p><svg-icon></svg-icon><select-menu>b</select-menu><p>c</p></article>", "a\n\nb\n\nc"),
        ("<div class='layout right-sidebar'><article><h1>T</h1><p>" + "word " * 60 + "</p></article></div><div>&copy; me</div>", "T\n\n" + ("word " * 60).strip()),
        ("<article><h2 class='header-big'>Big</h2><p>x</p></article>", "Big\n\nx"),
        ("<article><p title=\"x>first</p><p class='y'>second</p></article>", "first\n\nsecond"),
        ("<article><p title='a > b' data-x=it's>first</p><p>it's", "first\n\nit's"),
        ("<article><p>a<svg><title>t</title></svg>b<button>go</button></article>", "ab"),
        ("<article><ul><li class=share>x<li>kept</ul><p class=ad>x<div>kept too</div></article>", "kept\n\nkept too"),
        ("<form id=page><article><p>" + "word " * 60 + "</p></article></form>", ("word " * 60).strip()),
        ("<section id=comments><article>" + "word " * 60 + "</article></section><p>tiny</p>", "tiny"),
        ("<p>a < b</p><p>open <a href='x", "a < b\n\nopen"),
        ("<div " * 3000, ""),
        ("<div>" * 3000 + "deep" + "</section>" * 3000, "deep"),
        ("<!--><p>x</p><!-- no end <p>y</p>", "x"),
    ],
)
def test_html_of_odd_markup(page, text):
    assert html.main_text(page) == text


def test_html_of_very_long_pages():
    body = "".join(f"<p>paragraph {i} it's \"so\"</p>" for i in range(60_000))
    assert len(html.main_text(f"<article>{body}</article>").split("\n\n")) == 60_000
    assert html.main_text("<p title=\"" * 20_000) == ""


def test_rules_of_a_list(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! a comment\nblock ||ads.\n\n allow  /policy^ \n")
    rows = [(r["pattern"], r["verdict"], r["name"]) for r in urls.read_rules(spark, f"file://{tmp_path}/rules.txt").collect()]
    assert rows == [("||ads.", "block", None), ("/policy^", "allow", None)]
    with pytest.raises(ValueError):
        list(urls.parse_rules(["drop ||x."]))


def test_many_rules_by_index_and_by_join(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    pages = [(i, f"http://{r.choice(words)}.{r.choice(words)}.com/{r.choice(words)}/{r.choice(words)}-{r.choice(words)}?q") for i in range(400)]
    pages += [(None, pages[0][1]), (7, None), (7, "no scheme"), (8, "x://" + "w1." * 4000 + "com/" + "w2/" * 4000), *[(9, pages[1][1])] * 30]
    rules = [urls.UrlRule(f"||{r.choice(words)}.{r.choice(words)}.", r.choice(["block", "allow"])) for _ in range(20_000)]
    rules += [urls.UrlRule(f"/{r.choice(words)}/{r.choice(words)}-*", r.choice(["block", "allow"])) for _ in range(20_000)] + [urls.UrlRule("*9-w1*", "block"), *urls.NAMED]
    table = spark.createDataFrame([(p, u, "z") for p, u in pages], "page_id long, url string, URL string")
    by_index = sorted(map(str, urls.filter_urls(table, rules=rules).collect()))
    assert len(by_index) == len(pages) and {"block", "allow"} <= {x.split("verdict='")[1][:5] for x in by_index}
    monkeypatch.setattr(urls, "MAX_RULES", 100)
    assert sorted(map(str, urls.filter_urls(table, rules=rules).collect())) == by_index
    as_table = spark.createDataFrame([(x.pattern, x.verdict, x.name) for x in rules], "pattern string, verdict string, name string")
    assert sorted(map(str, urls.filter_urls(table, rules=as_table).collect())) == by_index
    assert urls.filter_urls(table.limit(0), rules=rules).count() == 0


def test_index_of_100_000_rules_tries_few():
    rules = [urls.UrlRule(f"||host{i}.example.", "block") for i in range(100_000)]
    index = urls.Index(rules, {"example": 10**6})
    assert max(map(len, index.by_token.values())) == 1 and not index.always
    assert index.judge("a.host77.example.com", "/x") == (None, "block") and index.judge("example.com", "/x") == (None, "allow")
