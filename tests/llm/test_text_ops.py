"""Quality rules, main text, chat format and URL rules."""

from __future__ import annotations

import html
import re
import time
from itertools import combinations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideway.llm import chat, quality, url_rules
from tideway.llm.chat import format_chat, format_turns, parts_of, read_turns
from tideway.llm.html_text import extract_text, main_text
from tideway.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_quality_measures(spark):
    texts = [
        None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "line\nline\n\nother\nline ", "é# ü* |<>&%$",
        " ".join(f"w{i % 30}" for i in range(100)), "p q r s t u v w x y p q r s t u v w z " + "p q r s t u v w", "long " * 40_000,
        " ".join(f"u{i}" for i in range(9_000)) * 2, "tab\x1cno\x85break\u2003same",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(5, texts[5])], "doc_id long, text string")
    df = df.selectExpr("doc_id", "text", "1 as n_words", "'x' as kept", "2 as _q")
    out = quality.quality(df)
    assert out.columns[:3] == ["doc_id", "text", "_q"]
    got = out.collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = slow_measures(r.text)
        assert {k: r[k] for k in want} == want, r.doc_id
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
    assert quality.quality(df.filter("false")).count() == 0


def slow_em(patterns, rounds=50):
    """Expectation-maximisation written with loops."""
    k = len(next(iter(patterns)))
    good, ag, ab = quality.PRIOR_GOOD, [quality.ACCUSE_GOOD] * k, [quality.ACCUSE_BAD] * k

    def chance(v):
        a, b = good, 1 - good
        for x, g, h in zip(v, ag, ab):
            if x:
                a *= g if x < 0 else 1 - g
                b *= h if x < 0 else 1 - h
        return a / (a + b)

    for _ in range(rounds):
        q = {v: chance(v) for v in patterns}
        share = lambda part, cast, prior: (part + 0.2 * cast * prior + prior) / (cast * 1.2 + 1)
        g2 = share(sum(n * q[v] for v, n in patterns.items()), sum(patterns.values()), quality.PRIOR_GOOD)
        new = []
        for side, prior in ((lambda p: p, quality.ACCUSE_GOOD), (lambda p: 1 - p, quality.ACCUSE_BAD)):
            new.append([
                share(sum(n * side(q[v]) for v, n in patterns.items() if v[i] < 0), sum(n * side(q[v]) for v, n in patterns.items() if v[i]), prior)
                for i in range(k)
            ])
        moved = max(abs(x - y) for x, y in zip([g2, *new[0], *new[1]], [good, *ag, *ab]))
        good, (ag, ab) = g2, new
        if moved < 1e-5:
            break
    return good, ag, ab, chance


def test_votes_are_fitted(spark):
    patterns = {(1, 1, 1): 800, (-1, -1, 1): 60, (1, -1, -1): 50, (-1, 1, -1): 40, (0, 1, 1): 30, (1, 1, -1): 20, (0, 0, 0): 5}
    df = spark.createDataFrame([(*v, float(n)) for v, n in patterns.items()], "a int, b int, c int, n double")
    model = quality.fit_votes(df, ["a", "b", "c"])
    good, ag, ab, chance = slow_em(patterns)
    assert model.good == pytest.approx(good) and list(model.accuse_good) == pytest.approx(ag) and list(model.accuse_bad) == pytest.approx(ab)
    for r in df.withColumn("q", model.posterior(["a", "b", "c"])).collect():
        assert r.q == pytest.approx(chance((r.a, r.b, r.c)))
    assert model.accuracy()[0][0] > 0.9


def test_quality_query(spark, sf):
    got = QUERIES["op1_quality_rules"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    both = got.merge(docs[["doc_id", "text"]], on="doc_id")
    assert len(both) == len(docs)
    for r in both.itertuples():
        want = slow_measures(r.text)
        assert {k: getattr(r, k) for k in want} == want
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert labels[(labels.quality_x == 1) & ~labels.base_failed].kept.mean() > 0.97
    assert labels[labels.quality_x == 0].kept.mean() < 0.2


PAGES = [
    ("<p>a&nbsp;b &lt;x&gt; &#8212; c", "a b <x> — c"), ("", ""), (None, ""), ("plain", "plain"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<article>in<b>li</b>ne <br>line<p>para<p>next</article><footer>no</footer>", "inline line para next"),
    ("<nav>menu</nav><header>site</header><main><header><h1>Title</h1>by me</header><p>body</p></main><aside>side</aside>", "Title body"),
    ("<article><p>text</p><div class='comments'><p>reader</p></div><form>x<input></form></article><div id=cookie-notice>ok</div>", "text"),
    ("<article><p>open", "open"), ("<![if x]><p>y", "y"), ("<article><p hidden>no</p><p>yes</p><div style='display: none'>no</div></article>", "yes"),
]


def test_main_text(spark):
    for page, text in PAGES:
        assert main_text(page) == text
    df = spark.createDataFrame([(i, p, "old", i) for i, (p, _) in enumerate(PAGES)], "page_id int, html string, text string, url int")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "text"]
    assert [r.text for r in out.orderBy("page_id").collect()] == [t for _, t in PAGES]
    assert extract_text(df.filter("false")).count() == 0


def test_main_text_without_an_article():
    para = "A long paragraph of running text, with <a href=x>one link</a> in it, that says something to the reader. "
    page = (
        "<div class=top><a href=1>Home</a> <a href=2>News</a> <a href=3>Mail</a></div><div class=box><h2>Head</h2><p>Short.</p>"
        + f"<p>{para}</p>" * 4 + "<p class=ad>Buy!<p>End.</div><div><a href=1>One</a><br><a href=2>Two</a></div>"
    )
    plain = re.sub("<[^>]*>", "", para).strip()
    assert main_text(page) == " ".join(["Head", "Short.", *[plain] * 4, "End."])


def test_main_text_of_several_regions():
    said = [f"A long paragraph number {i} of running text that says something to the reader, and then says more." for i in range(6)]
    p = [f"<p>{x}</p>" for x in said]
    menu = "<div class=top><a href=1>Home</a> <a href=2>News</a></div><div><a href=3>One</a><br><a href=4>Two</a></div>"
    whole = " ".join(["Title", *said])
    sections = f"<div id=content><h1>Title</h1><section>{''.join(p[:4])}</section><section>{''.join(p[4:])}</section></div>"
    for page in (sections, menu + sections, f"<body>{menu}{sections}</body>"):
        assert main_text(page) == whole
    assert main_text(f"{menu}<article>{''.join(p[:4])}</article><article>{''.join(p[4:])}</article>") == " ".join(said)
    for mark in ("post has-sidebar", "category-notices", "post has-header"):
        assert main_text(f"{menu}<article class='{mark}'><h1>Title</h1>{''.join(p)}</article>") == whole
    assert main_text(f"<article>{''.join(p)}<article class=comment><p>{said[0]} reader</p></article></article>") == " ".join(said)


def test_main_text_in_marked_wrappers():
    said = [f"A long paragraph number {i} of running text that says something to the reader, and then says more." for i in range(6)]
    body = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in said)
    whole = " ".join(["Title", *said])
    around = (
        "<nav><a href=1>Home</a> <a href=2>News</a></nav><div class='sidebar'><article><p>Teaser of another page.</p></article></div>{}"
        "<div class='cookie-notice'><p>We use cookies.</p></div><div id=comments><p>A reader says so.</p></div><footer>end</footer>"
    )
    marks = ("content no-sidebar", "page modal-open", "elementor-widget-container", "layout has-sidebar", "site page-header-fixed")
    for wrapper in [f"<div class='{m}'>{{}}</div>" for m in marks] + ["<form id=aspnetForm>{}</form>", "<form><div class='page popup'>{}</div></form>"]:
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", body):
            assert main_text(wrapper.format(around.format(inner))) == whole, (wrapper, inner)
            assert main_text(around.format(wrapper.format(inner))) == whole, (wrapper, inner)
    for m in marks:
        assert main_text(around.format(f"<article><div class='{m}'>{body}</div></article>")) == whole
    # Boilerplate stays out, even when it is longer than the article.
    long = f"<p>{' '.join(said)}</p>" * 3
    for extra in (f"<div class=advert>{long}</div>", f"<div id=comments>{long}</div>", f"<form>{long}<button>send</button></form>"):
        assert main_text(around.format(f"<article>{body}</article>{extra}")) == whole
        assert main_text(around.format(f"<article>{body}{extra}</article>")) == whole
    assert main_text(f"<body>{body}<div id=comments>{long}</div></body>") == whole
    assert main_text("<div class=menu><a href=1>Home</a> <a href=2>News</a></div>") == ""


def test_parsing_takes_linear_time():
    for tag in ("div", "font", "ul><li", "p><br", "article", "div class=ad", "form", "x"):
        start = time.perf_counter()
        text = main_text(f"<p>{f'<{tag}>a' * 50_000}end" + "</q>" * 50_000)
        assert text.endswith("end") or tag in ("div class=ad", "form")
        assert time.perf_counter() - start < 5, tag


def test_html_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        article = re.sub("<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(html.unescape(article).split()) and r.n_chars == len(r.text)


TEXTS = st.text(st.sampled_from("ab\\<|>\nn é😀") | st.characters(codec="utf-8"), max_size=30) | st.sampled_from([chat.START, chat.END, "<|image:0|>"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "odd\nrole", "a\\nb", "<|im_end|>"]), TEXTS), max_size=6))
def test_chat_reads_back(turns):
    made = format_turns([(role, parts_of(text)) for role, text in turns])
    assert read_turns(made.text) == turns
    assert [chat.unescape(made.text[a:b]) for a, b in made.loss] == [t for r, t in turns if r == "assistant"]


def test_chat_parts(spark):
    schema = "conv_id long, turn int, role string, parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>, n_turns int"
    part = lambda t, **k: (t, *[k.get(x) for x in ("text", "ref", "width", "height", "seconds", "pages")])
    rows = [
        (1, 2, "assistant", [part("text", text="see <|image:0|>"), part("image", ref="b.png", width=29, height=28)], 0),
        (1, 1, "user", [part("image", ref="a.png", width=56, height=56), part("text", text="what?"), part("audio", ref="s.wav", seconds=2.0), part("document", ref="d.pdf", pages=3)], 0),
        (2, None, None, None, 0), (2, 1, "user", [], 0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in format_chat(df, content_col="parts").collect()}
    one = got[1]
    assert one.formatted == (
        "<|im_start|>user\n<|image:0|>what?<|audio:1|><|document:2|><|im_end|>\n<|im_start|>assistant\nsee <\\|image:0|><|image:3|><|im_end|>\n"
    )
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 4), ("audio", "s.wav", 25), ("document", "d.pdf", 3072), ("image", "b.png", 2)]
    assert one.expanded_tokens == 4 + 25 + 3072 + 2 and one.n_turns == 2
    assert got[2].formatted == "<|im_start|>user\n<|im_end|>\n<|im_start|>\n<|im_end|>\n"
    with pytest.raises(ValueError):
        parts_of([{"type": "video"}])
    assert format_chat(df.filter("false"), content_col="parts").count() == 0


def test_chat_ties_and_nulls(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (7, None, "assistant", None), (7, 1, None, "x"), (7, 1, None, "x")]
    got = {r.conv_id: r for r in format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert read_turns(got[None].formatted) == [("user", "a"), ("user", "b")]
    assert read_turns(got[7].formatted) == [("", "x"), ("", "x"), ("assistant", "")]


LISTED = [
    url_rules.ListedRule("com", "/", "allow"), url_rules.ListedRule("example.com", "/en/", "block"),
    url_rules.ListedRule("www.example.com", "/en/", "allow"), url_rules.ListedRule("net", "/fr/", "block"),
]


def test_url_parts_and_listed_rules(spark):
    urls = [
        ("HTTP://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/?q=http://z/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://b.com", "b.com", "", None, "allow"),
        ("http://a.net/fr", "a.net", "/fr", None, "allow"), ("http://É.NET/fr/x", "É.net", "/fr/x", "net/fr/", "block"),
        ("no scheme/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("x\ny://h.com?/en/", "h.com", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "old", 1) for i, u in enumerate(urls)], "page_id int, url string, verdict string, tokens int")
    out = url_rules.judge_urls(df, LISTED, support=0.9)
    assert out.columns == ["page_id", "url", "tokens", "host", "path", "rule", "verdict", "mined", "confidence"]
    got = out.orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == urls
    assert url_rules.judge_urls(df.filter("false"), LISTED).count() == 0
    assert url_rules.judge_urls(df.filter("url is null"), []).first().verdict == "allow"


def slow_rules(rows, support, confidence, longest):
    found = {}
    for size in range(1, longest + 1):
        for tokens, _ in rows:
            for c in combinations(sorted(tokens), size):
                if frozenset(c) in found:
                    continue
                hit = [v for t, v in rows if set(c) <= set(t)]
                found[frozenset(c)] = {v: (hit.count(v) / len(hit), hit.count(v) / len(rows)) for v in set(hit)}
    passed = {(t, v): x for t, by in found.items() for v, x in by.items() if x[0] >= confidence and x[1] >= support}
    return {
        (t, v): x for (t, v), x in passed.items()
        if not any((frozenset(s), v) in passed and passed[frozenset(s), v][0] >= x[0] for k in range(1, len(t)) for s in combinations(sorted(t), k))
    }


def test_mined_rules_are_the_brute_force_ones(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    url = pages.url
    name, verdict = url_rules.listed_rule(LISTED, url_rules.host_of(url), url_rules.path_of(url))
    labelled = pages.select(url_rules.tokens_of(url_rules.host_of(url), url_rules.path_of(url)).alias("tokens"), verdict.alias("verdict")).filter("verdict is not null")
    rows = [(r.tokens, r.verdict) for r in labelled.collect()]
    want = slow_rules(rows, 0.05, 0.8, 3)
    got = {(r.tokens, r.verdict): (r.confidence, r.support) for r in url_rules.mine_rules(labelled, 0.05, 0.8, 3)}
    assert got.keys() == want.keys() and got
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    index = url_rules.inverted_index(url_rules.mine_rules(labelled, 0.05, 0.8, 3))
    rules = [r for by in index.values() for r in by]
    for tokens, _ in rows:
        met = [r for r in rules if r.tokens <= set(tokens)]
        assert url_rules.best_rule(index, tokens) == (min(met, key=url_rules.MinedRule.order) if met else None)


def test_repeated_long_urls_are_mined(spark):
    words = [f"word{i}" for i in range(30)]
    rows = [(["end=com", *words], "block")] * 100 + [(["end=com", "path=x"], "allow")] * 50 + [(["end=net", "path=x"], "allow")] * 50
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9)
    want = {(frozenset([w]), "block") for w in words} | {(frozenset([w]), "allow") for w in ("path=x", "end=net")}
    assert {(r.tokens, r.verdict) for r in rules} == want
    assert url_rules.mine_rules(spark.createDataFrame([(None, "block"), (["a"], None)], "tokens array<string>, verdict string")) == []


def test_url_query(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op9_url_rules"](spark, sf).collect()}
    assert got.keys() == urls.keys()
    listed = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    tokens, named = {}, {}
    for k, url in urls.items():
        rest = (url or "").partition("://")[2]
        host, path = re.match("[^/?#]*", rest)[0], re.match("[^/?#]*([^?#]*)", rest)[1]
        host = host.translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
        fits = [r for r in listed if f".{host}".endswith(f".{r[0]}") and path.startswith(r[1])]
        named[k] = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, named[k] and named[k][0] + named[k][1])
        labels = [x for x in host.split(".") if x]
        lower = path.translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
        tokens[k] = {f"path={w}" for w in re.split("[/.]+", re.sub("[0-9]+", "#", lower)) if w}
        tokens[k] |= {f"end={x}" for x in labels[-1:]} | {f"label={x}" for x in labels[:-2]} | {f"domain={'.'.join(labels[-2:])}"}
    known = [(sorted(tokens[k]), r[2]) for k, r in named.items() if r]
    mined = [url_rules.MinedRule(t, v, *x) for (t, v), x in slow_rules(known, 0.005, 0.9, 3).items()]
    for k, r in got.items():
        met = min((m for m in mined if m.tokens <= tokens[k]), key=url_rules.MinedRule.order, default=None)
        assert r.verdict == (named[k][2] if named[k] else met.verdict if met else "allow")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    # Integers with nulls are floats in one frame and not in the other; widths still have to agree.
    want = con.execute(ORACLES[name]).df().convert_dtypes()
    got = QUERIES[name](spark, sf).toPandas()[list(want.columns)].convert_dtypes()
    by = list(want.columns)
    assert got.dtypes.to_dict() == want.dtypes.to_dict()
    assert got.sort_values(by).reset_index(drop=True).equals(want.sort_values(by).reset_index(drop=True))
