"""Language, quality, URL and extraction operators: held-out accuracy, rules, layouts, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import extraction, language, quality, urls

SYLLABLES = {"aa": ["the", "ing", "wh", "ous"], "bb": ["que", "eau", "é", "oi"], "cc": ["sch", "ung", "ü", "ein"]}
DOCS = "doc_id long, text string, lang string, score string, lang_pred string, label int"


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_held_out_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang, rng.choice([5, 30, 200])), lang, "x", "y", 0) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    model = language.LanguageModel.fit(spark.createDataFrame(rows[:200], DOCS).union(spark.createDataFrame([(9, "zz zz", None, "", "", 0)], DOCS)))
    odd = [(1, None, "aa", "", "", 0), (2, "", "aa", "", "", 0), (3, "123 !!", "aa", "", "", 0), (4, sentence(rng, "bb", 90000), None, "", "", 0)]
    got = {r["doc_id"]: r for r in model.label(spark.createDataFrame([(1000 + r[0], *r[1:]) for r in rows[200:]] + odd, DOCS)).collect()}
    assert np.mean([got[1000 + r[0]]["lang_pred"] == r[2] for r in rows[200:]]) > 0.98
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 3 + ["bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["ambiguous"]
    assert model.predict(sentence(rng, "aa", 40) + sentence(rng, "cc", 40))[1] < model.predict(sentence(rng, "aa", 80))[1] + 1e-9
    none = language.LanguageModel.fit(spark.createDataFrame([], DOCS))
    assert none.predict("text") == ("und", 0.0, True)
    one = language.LanguageModel.fit(spark.createDataFrame(rows[:1], DOCS))
    assert one.predict("text")[:2] == (rows[0][2], 1.0)


@pytest.mark.parametrize("n", [2, 4, 6, 7, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    distance = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 1e9
    assert distance.min() >= max(1, code.shape[1] // 5)


def test_quality_held_out_and_edges(spark):
    rng = random.Random(6)

    def text(good):
        words = sentence(rng, "aa", 60).split()
        return " ".join(words) if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60)])

    rows = [(i, text(i % 4 > 0), None, "x", "y", int(i % 4 > 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, DOCS)
    model = quality.QualityModel.fit(frame.filter("doc_id < 400").select("doc_id", "text", "label"))
    scored = model.score(frame.filter("doc_id >= 400")).toPandas()
    assert ((scored["score"].astype(float) >= 0.3) == (scored["label"] == 1)).mean() > 0.97
    odd = model.score(spark.createDataFrame([(1, None, None, "", "", 0), (2, "", None, "", "", 0), (3, "word " * 300000, None, "", "", 0)], DOCS)).toPandas()
    assert odd["score"].between(0, 1).all() and odd["score"].iloc[0] == odd["score"].iloc[1]
    empty = quality.QualityModel.fit(frame.limit(0).select("doc_id", "text", "label"))
    assert set(empty.score(frame.limit(3)).toPandas()["score"]) == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert sorted(map(tuple, quality.sample_labels(labels, "quality").collect())) == [(1, 0), (2, 1)]


PAGES = "page_id long, url string, host string, score string"


def test_urls_hosts_paths_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no-scheme.org/es/": ("", "", None), "http://A.Example.ORG/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"), "https://notexample.org/en/12": ("notexample.org", "/en/12", "org/"),
        "x://org?q": ("org", "", None), "http://a.com/de/#": ("a.com", "/de/", "com/de/"), "http://com/fr/": ("com", "/fr/", "com/fr/"), "http://É.com/fr": ("É.com", "/fr", None),
        "http://a.org/\nb": ("a.org", "/\nb", "org/"), "http://h.net/" + "a/" * 20000: ("h.net", "/" + "a/" * 20000, None), "a://b://c.org/": ("b:", "//c.org/", None),
    }
    rows = [(i, u, "clash", "clash") for i, u in enumerate(cases)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, PAGES), urls.RULES).collect()}
    for i, (url, want) in enumerate(cases.items()):
        row = got[i]
        assert (row["host"], row["path"], row["rule"]) == want, url
        assert row["verdict"] in ("allow", "block") and (row["rule"] is None) == (row["score"] is not None)
    assert urls.judge(spark.createDataFrame([], PAGES), urls.RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame(rows, PAGES), []).collect()} == {"allow"}


def test_url_trees_learn(spark):
    rng = random.Random(8)
    rows = [(f"http://h{rng.randrange(50)}.{rng.choice(['com', 'net'])}/{'x' * rng.randrange(3, 9)}" + (f"/{rng.randrange(10**9)}?a=1&b=2&c={rng.randrange(10**6)}" if bad else ""), int(bad)) for bad in [rng.random() < 0.4 for _ in range(600)]]
    frame = spark.createDataFrame(rows, "_url string, _label int").withColumns({"_host": urls.host_of(F.col("_url")), "_path": urls.path_of(F.col("_url"))})
    model = urls.UrlModel.fit(frame.limit(400), rounds=5)
    scored = model.score(frame).toPandas()
    assert ((scored["score"] >= 0.5) == (scored["_label"] == 1)).mean() > 0.97
    assert "Python" not in model.score(frame)._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


LAYOUTS = [
    ("<article><h1>T &amp; t</h1><p><b>One,\n two<br><p>Three</article><footer>&copy; x</footer>", "T & t\n\nOne, two\n\nThree"),
    ("<body><nav><a href=/>Home</a></nav><div id=main><p>First, long enough text, with commas.</p><p>Second one, too.</p></div><aside>Side, side, side</aside>", "First, long enough text, with commas.\n\nSecond one, too."),
    ("<main><p>Text, text.</p><div class='cookie-notice'>We, use, cookies, a, lot</div><form><p>Name, mail</p></form><section id=comments><p>Nice, very, nice, post</p></section></main>", "Text, text."),
    ("<div><p>Only <a href=x>links</a> here and there, see.</p></div><ul><li><a href=a>a</a></li><li><a href=b>b</a></li></ul>", "Only links here and there, see."),
    ("<article><p>a &lt;b&gt; &#233;&nbsp;x</p><script>if (a < b) { p('</p>') }</script><style>p{}</style><!-- <p>no</p> --><p>end", "a <b> é x\n\nend"),
    ("<article><p>cut in an entity &am", "cut in an entity &am"), ("plain text", "plain text"), ("<p", ""), ("<script>x", ""), ("", ""), (None, ""),
    ("<div class=post><table><tr><td>one, two</td><td>three</td></tr></table></div>", "one, two\n\nthree"),
    ("<article><ul><li>one<li>two <a href=x>x</a></ul></article>", "one\n\ntwo x"),
    ("<p title='a > b'>quoted</p>", "quoted"), ("<article><p>x < y and y > z</p></article>", "x < y and y > z"),
]


@pytest.mark.parametrize("html, text", LAYOUTS)
def test_extraction_layouts(html, text):
    assert extraction.extract(html) == text


def test_extraction_over_rows(spark):
    rows = [(i, "u", h, "clash", 1) for i, (h, _) in enumerate(LAYOUTS)] + [(99, "u", "<div>" * 3000 + "deep, text" + "</div>" * 3000, "", 1), (99, "u", "<p>" + "word, " * 100000, "", 1)]
    got = extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, n_chars int")).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got if r["page_id"] < 99} == {i: t for i, (_, t) in enumerate(LAYOUTS)}
    assert all(r["n_chars"] == len(r["text"]) for r in got) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert extraction.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


A, B = "The first part, long enough, with commas, says this.", "The second part, as long, with commas too, says that."


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<main><article><p>{A}</p></article><article><p>{B}</p></article></main>", f"{A}\n\n{B}"),
        (f"<body><article><p>{A}</p></article><article><p>{B}</p></article></body>", f"{A}\n\n{B}"),
        (f"<div><article><p>{A}</p></article><p>{B}</p><ul><li><a href=x>x</a></li><li><a href=y>y</a></li></ul></div>", f"{A}\n\n{B}"),
        (f"<div class='post no-sidebar'><p>{A}</p></div>", A),
        (f"<div class='hentry comments-open'><p>{A}</p></div><div class=share><a href=x>Share this</a></div>", A),
        (f"<div class='content has-header'><p>{A}</p><div class='ad'>Buy, now</div></div>", A),
        ("".join(f"<div class='post no-sidebar' id=p{i}><p>{A}</p></div>" for i in range(6)), "\n\n".join([A] * 6)),
        (f"<div class=sidebar>{'<a href=x>many, links, here</a> ' * 20}</div><div><p>{A}</p></div>", A),
    ],
)
def test_extraction_keeps_every_part(html, text):
    assert extraction.extract(html) == text


LONG = "A reader writes at some length, with commas, and with more words than the article itself has in all of its text."
COMMENTS = "<section id=comments>" + f"<div class=comment><p>{LONG}</p></div>" * 5 + "</section>"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class=post><p>{A}</p></div>{COMMENTS}", A),
        (f"<main><article><p>{A}</p></article>{COMMENTS}</main>", A),
        (f"<article><p>Short.</p></article><div class=newsletter><p>{LONG}</p><p>{LONG}</p></div>", "Short."),
        (f"<article><p>Short.</p></article><div class=related-posts><p>{LONG}</p></div>", "Short."),
        (f"<div class='cookie-notice'><p>{LONG}</p></div><div><p>{A}</p></div>", A),
        (f"<div id=cookieBanner><p>{LONG}</p></div><p>Short.</p>", "Short."),
        (f"<article><p>{A}</p></article><article class=comment><p>{LONG}</p></article>", A),
        (f"<article class='post comments-open'><p>{A}</p><article class='comment even'><p>{LONG}</p></article></article>", A),
        (f"<article><p>{A}</p><h2>Further reading</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article>", f"{A}\n\nFurther reading\n\nOne\n\nTwo"),
        (f"<article><p>{A}</p><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul><p>{B}</p></article>", f"{A}\n\nOne\n\nTwo\n\n{B}"),
        (f"<article><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><p>{A}</p><ul><li><a href=x>tag</a></li><li><a href=y>tag two</a></li></ul></article>", A),
        (f"<div class='widget'><p>{A}</p></div>", A),
        (f"<div class='widget'><p>{A}</p></div><p>© 2024</p>", f"{A}\n\n© 2024"),
        (f"<div class=ad>{LONG}</div><article><h1>title only</h1></article>", "title only"),
    ],
)
def test_extraction_by_what_a_part_is(html, text):
    assert extraction.extract(html) == text
