"""Language models, wrappers, tiling and the pipeline."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from deckscope.llm import html_wrapper, langid, string_tiling
from deckscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --- language ---------------------------------------------------------------
def kneser_ney(words, order):
    """Interpolated Kneser-Ney over bordered words, by dictionaries: p(character, context)."""
    grams = [{} for _ in range(order + 1)]
    for w in words:
        w = "$" + w + "$"
        for m in range(1, order + 1):
            for e in range(max(2, m), len(w) + 1):
                grams[m][w[e - m : e]] = grams[m].get(w[e - m : e], 0) + 1
    counts = [None, *grams[1:]]
    for m in range(1, order):
        left = {}
        for g in grams[m + 1]:
            left[g[1:]] = left.get(g[1:], 0) + 1
        counts[m] = {g: left.get(g) or n for g, n in grams[m].items()}
    d = []
    for m in range(1, order + 1):
        ones, twos = (sum(n == k for n in counts[m].values()) for k in (1, 2))
        d.append(ones / (ones + 2 * twos) if ones else 0.5)

    def p(ch, context):
        m = len(context) + 1
        seen = {g: n for g, n in counts[m].items() if g[:-1] == context}
        below = p(ch, context[1:]) if m > 1 else 1 / (len(counts[1]) + 1)
        if not seen:
            return below
        total = sum(seen.values())
        gamma = min(1.0, max(d[m - 1] * len(seen), 1e-9) / total)
        return max(seen.get(context + ch, 0) - d[m - 1], 0) / total + gamma * below

    return p, counts


def test_kneser_ney_is_plain(spark):
    texts = {"aa": "banana bandana band and sand hand strand", "bb": "ßtrudel über alles zwölf boxer boxen"}
    df = spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, lang string")
    model = langid.train(df, sample_rows=10)
    for k, lang in enumerate(model.langs):
        p, counts = kneser_ney(texts[lang].split(), langid.ORDER)
        for word in ("banana", "sandy", "über", "box", "ñq"):
            want = 0.0
            whole = "$" + word + "$"
            for e in range(1, len(whole)):
                context = whole[max(0, e - langid.ORDER + 1) : e]
                known = whole[e] in set().union(*(set(t.replace(" ", "")) for t in texts.values())) | {"$"}
                if known:
                    size = len({c for t in texts.values() for c in t.replace(" ", "")} | {"$"})
                    got = _p(p, counts, whole[e], context, size)
                else:
                    got = _p(p, counts, whole[e], context, len({c for t in texts.values() for c in t.replace(" ", "")} | {"$"}))
                want += np.log(got)
            w = langid.LetterWords([word.encode()])
            assert abs(model.word_scores(w)[0, k] - want) < 1e-6, (lang, word)


def _p(p, counts, ch, context, size):
    """``p`` with the alphabet of all languages."""
    if not context:
        base, own = p(ch, ""), len(counts[1])
        total = sum(counts[1].values())
        ones, twos = (sum(n == k for n in counts[1].values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        gamma = min(1.0, max(d * own, 1e-9) / total)
        del base
        return max(counts[1].get(ch, 0) - d, 0) / total + gamma / (size + 1)
    m = len(context) + 1
    seen = {g: n for g, n in counts[m].items() if g[:-1] == context}
    below = _p(p, counts, ch, context[1:], size)
    if not seen:
        return below
    ones, twos = (sum(n == k for n in counts[m].values()) for k in (1, 2))
    d, total = (ones / (ones + 2 * twos) if ones else 0.5), sum(seen.values())
    return max(seen.get(context + ch, 0) - d, 0) / total + min(1.0, max(d * len(seen), 1e-9) / total) * below


def test_language_held_out(spark):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    out = [d for d in docs if got[d.doc_id].held_out]
    assert {d.doc_id for d in out} == {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0}
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in out if d.lang]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_hard(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 34 !!", "en"), (None, "the dog", "en"), (6, "la la la", None), (7, "und the " * 20000, "en"), (1, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "2 as h")
    got = langid.identify(df, langid.train(df.where("doc_id < 3"))).collect()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert len(got) == len(rows) and {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en")} <= by
    assert {r.lang_pred for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.train(df)).count() == 0


def test_ngram_pruning_keeps_the_model_small(spark):
    df = spark.createDataFrame([("the cat and the dog that sat there " * 3 + "q" * i, "en") for i in range(5)], "text string, lang string")
    model = langid.train(df, most=20)
    assert sum(len(k.keys) for k in model.keys[1:]) <= 20 and model.predict([b"the cat"])[0].tolist() == [0]


def test_calibration_takes_every_row(spark):
    """Temperature and rejection by a plain count over all training rows, however they are dealt; more than 4000 of them."""
    rng = np.random.default_rng(4)
    words = {"en": "the cat and dog that sat there with hand".split(), "de": "der hund und die katze sass dort mit hand".split()}
    rows = [(i, " ".join(rng.choice(words[x], 4)), x) for i in range(2600) for x in words] + [(1, None, "en"), (2, "12", "de"), (3, "xyzzy", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, other = langid.train(df), langid.train(df.repartition(5))
    for k, lang in enumerate(model.langs):
        own = np.sort(model.cross_entropy([t.encode() for _, t, x in rows if x == lang and t and t != "12"])[:, k])
        want = np.ceil(own * langid.PARTS)[-(-999 * len(own) // 1000) - 1] / langid.PARTS + 0.1
        assert model.worst[k] == other.worst[k] == want
    assert model.scale == other.scale and sorted(langid.identify(df, model).collect(), key=str) == sorted(langid.identify(df, other).collect(), key=str)


def test_no_ngram_is_dropped(spark):
    """Every n-gram counts, however many there are, and a model in many blocks scores as one in one."""
    assert not hasattr(langid, "MOST_NGRAMS")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "text", "lang")
    one, many = langid.train(docs), langid.train(docs, block=500)
    assert len(one.blocks) == 1 < 5 < len(many.blocks)
    total = langid.count_ngrams(docs).where("m > 1").select("m", "h").distinct().count()
    assert sum(len(k.keys) for k in one.keys[1:]) == sum(len(k.keys) for k in many.keys[1:]) == total
    w = langid.LetterWords([b"the hand und \xc3\xbcber q xyzzy", "日本".encode()])
    assert np.allclose(one.word_scores(w), many.word_scores(w), atol=1e-9)
    assert sorted(langid.identify(docs, one).collect()) == sorted(langid.identify(docs, many).collect())


# --- pages ------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title {i}</h1><span class=byline>By me</span></header><p>First <b>bold</b>ly &eacute;&#8217;&nbsp;x {i}<p>Second<br>line &lt;b&gt;
<div class="ad">Buy {i}</div><!-- no --><ul><li>one<li>two</ul><pre>a
  b</pre>{more}</article><section id="comments"><p>Nice post {i}</p></section></main><aside>Side {i}</aside><form><p>Mail</p><input></form><footer>&copy; {i}</footer></body>"""


def pages(n, more=lambda i: ""):
    return [(i, f"https://user@Example.com/{i}", PAGE.format(i=i, more=more(i))) for i in range(n)]


def test_pages(spark):
    rows = pages(8, lambda i: "<p>Read on our site</p>" if i % 2 else "")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as main").repartition(3)
    for limit in (1 << 20, 0):  # decisions broadcast, and joined
        got = {r.page_id: r for r in html_wrapper.extract(df, broadcast_bytes=limit).collect()}
        for i in range(8):
            want = f"Title {i} First boldly é’ x {i} Second line <b> one two a b" + (" Read on our site" if i % 2 else "")
            assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == rows[i][1]


def test_template_texts_go(spark):
    rows = [(i, "http://a.org/x", f"<body><div id=x><p>Long text number {i}</p><p>Continue reading</p></div><div id=y>t{i}</div></body>") for i in range(6)]
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"Long text number {i}" for i in range(6)]


def test_pages_without_text_veto_no_template(spark):
    rows = [(i, "http://a.org/x", f"<body><div id=x><p>Long text number {i}</p><p>Continue reading</p></div></body>") for i in range(6)]
    rows += [(6, "http://a.org/y", None), (7, "http://a.org/z", ""), (8, "http://a.org/w", "<body><div id=x></div></body>")]
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert sorted(r.text for r in got) == ["", "", "", *(f"Long text number {i}" for i in range(6))]


def test_pages_hard(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/1", "plain text &amp; more"), (4, "http://h/2", "<p>a<p>b</i></div><b>c"), (5, "http://h/3", "<div" + " x" * 50), (None, "http://h/4", "<article>only</article>"),
            (6, "http://i/", "<p>" + "long word " * 50000), (6, "http://i/", "<p>" + "long word " * 50000), (7, "http://j/", "<script>never closed <p>x"), (8, "http://j/", "<!-- open <p>x"), (9, "http://k/", "<article>" * 300 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_wrapper.extract(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[7] == by[8] == "" and by[3] == "plain text & more" and by[4] == "a b c" and by[None] == "only" and by[9] == "deep"
    assert by[6] == ("long word " * 50000).strip()
    assert html_wrapper.extract(df.limit(0)).count() == 0


def pattern(items):
    """A node's items as Python's regular expression over labels that each end with a space."""
    out = ""
    for labels, optional, repeated in items:
        inner = "".join(f"(?:{re.escape(x)} )?" if len(labels) > 1 else f"{re.escape(x)} " for x in labels)
        out += f"(?:{inner})" + ("*" if repeated and optional else "+" if repeated else "?" if optional else "")
    return out


def test_wrapper_explains_its_pages(spark):
    """The inferred expressions match every stream they were made from, and say what is optional and repeated."""
    rng = random.Random(2)
    rows = []
    for k in range(30):
        s = "<h1>t</h1>" + "<p>x</p>" * rng.randint(1, 5)
        if rng.random() < 0.5:
            s += "<ul>" + "<li>y</li>" * rng.randint(1, 4) + "</ul>"
        for _ in range(rng.randint(0, 3)):
            s += rng.choice(["<h2>a</h2><table></table>", "<table></table>", "<h2>b</h2>"])
        rows.append((f"http://h/{k}", f"<body><div id=a{k}>{s}<hr></div></body>"))
    got = {r.node: r.expression for r in html_wrapper.infer_wrappers(spark.createDataFrame(rows, "url string, html string").repartition(5)).collect()}
    assert got["body"] == "div#a0" and got["body div#a0 ul"] == "(li)+" and got["body div#a0 ul li"] == "#"
    assert got["body div#a0"] == "h1 (p)+ (ul)? (((h2)? (table)?)+)? hr" and not any("|" in x for x in got.values())
    nodes = {}
    for _, page in rows:
        for path, instances in html_wrapper.Page(page).children.items():
            for x in instances:
                nodes.setdefault(path, html_wrapper.Node()).align(x)
    assert {" ".join(k): html_wrapper.expression(v.items()) for k, v in nodes.items()} == got
    for _, page in rows:
        for path, instances in html_wrapper.Page(page).children.items():
            assert all(re.fullmatch(pattern(nodes[path].items()), "".join(f"{y} " for y in x)) for x in instances)


@pytest.mark.parametrize("seed", range(4))
def test_node_items_explain_all_small_streams(seed):
    """Against brute force: any streams are explained; one label stands in one item; only labels that follow each other in a circle are grouped."""
    rng = random.Random(seed)
    for _ in range(200):
        streams = [[rng.choice("abcde") for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 5))]
        node = html_wrapper.Node()
        for s in streams:
            node.align(s)
        items = node.items()
        flat = [x for labels, _, _ in items for x in labels]
        assert sorted(flat) == sorted(set("".join(map("".join, streams))))
        assert all(re.fullmatch(pattern(items), "".join(f"{x} " for x in s)) for s in streams)
        reach = {(a, b) for s in streams for a, b in zip(s, s[1:])}
        for _ in range(5):
            reach |= {(a, d) for a, b in reach for c, d in reach if b == c}
        for labels, optional, repeated in items:
            assert len(labels) == 1 or all((a, b) in reach for a in labels for b in labels)
            assert repeated == ((labels[0], labels[0]) in reach)
            if len(labels) == 1:
                assert optional == any(labels[0] not in s for s in streams)


MENU = "<div class=t><a href=/>Home</a> <a href=/p>Prices</a> <a href=/i>Imprint</a></div>"


def divs(n, seed=3):
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randint(0, 99)}" for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        parts = [words(4), *(words(rng.randint(5, 40)) for _ in range(rng.randint(1, 6)))]
        rows.append((i, f"http://h.org/{i}", f"<body>{MENU}<div class=c><h1>{parts[0]}</h1>{''.join(f'<p>{x}</p>' for x in parts[1:])}</div><div class=z>{words(3)}</div><div>© us</div></body>"))
        want[i] = " ".join(parts)
    return rows, want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_regions_without_telling_names(spark, limit):
    """No article, main or listed class word; an error page and a page with an article decide for no other page."""
    rows, want = divs(30)
    rows += [(100, "http://h.org/e", f"<body>{MENU}<div class=c><p>Error 404 not found here</p></div></body>"), (101, "http://h.org/a", f"<body>{MENU}<article><p>only this one</p></article></body>"),
             (102, "http://h.org/n", None), (103, "http://other.org/", "<body><div><p>alone on its host</p></div></body>")]
    want |= {100: "Error 404 not found here", 101: "only this one", 102: "", 103: "alone on its host"}
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), broadcast_bytes=limit)
    assert {r.page_id: r.text for r in got.collect()} == want


def test_rows_come_from_the_wrapper(spark, monkeypatch):
    """Without the inferred slots there is no text."""
    rows, _ = divs(6)
    plain = html_wrapper.slots
    monkeypatch.setattr(html_wrapper, "slots", lambda *a: (lambda read, own, template: (read, own.limit(0), template.limit(0)))(*plain(*a)))
    got = html_wrapper.extract(spark.createDataFrame(rows + pages(3), "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {""}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_are_read_by_the_expressions(spark, monkeypatch, limit):
    """Empty expressions explain no text; where a paragraph may not come again, pages with more than one have no slots there."""
    rows, want = divs(30)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    plain = getattr(html_wrapper, "aligned", html_wrapper.infer_wrappers)

    def got(expression):
        monkeypatch.setattr(html_wrapper, "aligned", lambda *a: plain(*a).withColumn("expression", expression), raising=False)
        return {r.page_id: r.text for r in html_wrapper.extract(df, broadcast_bytes=limit).collect()}

    assert got(F.col("expression")) == want
    assert set(got(F.lit("")).values()) == {""}
    texts = got(F.when(F.col("expression") == "h1 (p)+", "h1 p").otherwise(F.col("expression")))
    once = [i for i, _, page in rows if page.count("<p>") == 1]
    assert once and len(once) < 30
    for i in want:
        assert texts[i] == want[i] if i in once else not any(x in texts[i] for x in re.findall("<(?:h1|p)>([^<]*)", rows[i][2]))


@pytest.mark.parametrize("seed", range(3))
def test_expressions_are_matched_as_regular_expressions(seed):
    """Against Python's own: written, read back and matched on streams of their own and on others."""
    rng = random.Random(seed)
    for _ in range(300):
        node = html_wrapper.Node()
        for _ in range(rng.randint(1, 4)):
            node.align([rng.choice("abcd#") for _ in range(rng.randint(0, 5))])
        items = html_wrapper.read_expression(html_wrapper.expression(node.items()))
        assert items == node.items()
        codes = dict(html_wrapper.rules(items))
        for _ in range(30):
            s = [rng.choice("abcd#e") for _ in range(rng.randint(0, 5))]
            assert html_wrapper.explained([codes.get(x) for x in (*s, "")]) == bool(re.fullmatch(pattern(items), "".join(f"{x} " for x in s)))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_labels_with_signs_of_expressions(spark, limit):
    """Classes, ids and element names with brackets, marks, spaces and line ends, and pages whose parts stand in other orders."""
    odd = ["<div class='w-[calc(1+2)] a?b'>{}</div>", "<p id='a (b)+ \n?'>{}</p>", "<x(y)?>{}</x(y)?>", "<p id='\\'>{}</p>"]
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(9):
        parts = [(rng.choice(odd), f"text {i} {k}") for k in range(6)]
        rows.append((i, "http://h/", f"<body><div>{''.join(x.format(t) for x, t in parts)}</div></body>"))
        want[i] = " ".join(t for _, t in parts)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_wrapper.extract(df, broadcast_bytes=limit).collect()} == want
    assert {html_wrapper.expression(html_wrapper.read_expression(r.expression)) == r.expression for r in html_wrapper.infer_wrappers(df).collect()} == {True}


def test_long_template_texts_and_repeated_pages(spark):
    """A constant text of any length goes; copies of one page agree with themselves only."""
    long = "we use this very long sentence on each page of ours " * 4
    rows = [(i, "http://h/", f"<body><div><p>{long}</p><p>own text {i} here</p></div></body>") for i in range(6)]
    rows += [(10 + i, "http://copies/", "<body><div><p>the same page</p><p>again and again</p></div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own text {i} here" for i in range(6)) and {got[10 + i] for i in range(20)} == {"the same page again and again"}


def test_large_page(spark):
    """Twenty thousand blocks of irregular kinds in seconds."""
    import time

    rng = random.Random(1)
    page = "<body><div>" + "".join(rng.choice(["<p>x{0}</p>", "<h2>y{0}</h2>", "<ul><li>z{0}</ul>", "<table><tr><td>v{0}</table>"]).format(i) for i in range(20_000)) + "</div></body>"
    t = time.time()
    got = html_wrapper.extract(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).collect()
    assert len(got[0].text.split()) == 20_000 and time.time() - t < 30
    assert html_wrapper.infer_wrappers(spark.createDataFrame([("http://h/", page)], "url string, html string")).count() > 3


# --- decontamination --------------------------------------------------------
def tokens(text):
    return re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", (text or "").translate(brute.LOW)) if text and text.isascii() else re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").translate(brute.LOW))


def tiles(doc, item, m=5):
    """Greedy string tiling as published: longest common unmarked runs, marked one by one."""
    a, b = tokens(doc), tokens(item)
    m = min(m, len(b))
    if not m:
        return 0, 0
    x, y, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while j + n < len(b) and i + n < len(a) and a[i + n] == b[j + n] and not x[i + n] and not y[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < m:
            return covered, len(b)
        x[i : i + n] = [True] * n
        y[j : j + n] = [True] * n
        covered += n


def test_tiling_is_greedy_string_tiling(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(2, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "é ü, É")]
    docs = [(1, None), (2, ""), (None, items[0][1]), (3, "x, é! ü É"), (3, "x, é! ü É")]
    for i in range(40):
        _, t = rng.choice(items[:12])
        t = t.split()
        cut = rng.randint(0, len(t))
        docs.append((10 + i, " ".join(rng.choices(words, k=8)) + " " + " ".join(t[cut:]).upper() + "... " + " ".join(t[:cut]) + " z " + " ".join(rng.choices(words, k=rng.randint(0, 9)))))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as x")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.item_tokens, r.covered_tokens) for r in string_tiling.contaminated_pairs(df, bench).collect())
    want = sorted((d or 0, i, n, c) for d, t in docs for i, s in items for c, n in [tiles(t, s)] if n and c and 100 * c >= string_tiling.PERCENT * n)
    assert got == want and len(got) > 20
    kept = string_tiling.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, _ in docs if (d or 0) not in {w[0] for w in want})
    assert string_tiling.contaminated_pairs(df.limit(0), bench).count() == 0 and string_tiling.contaminated_pairs(df, bench.limit(0)).count() == 0
    assert string_tiling.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_tiling_of_repeated_words_keeps_runs_not_pairs(monkeypatch):
    import tracemalloc

    from deckscope.llm.texts import PUNCTUATION, Words

    rng = random.Random(9)
    items = [(1, "a " * 9), (2, "a b " * 7), (3, "a a b a b b a a"), (4, "b"), (5, "a b a"), (6, "c " + "a " * 6 + "b c a b")]
    texts = [" ".join(rng.choices("abc", weights=[6, 3, 1], k=rng.randint(0, 40))) for _ in range(60)] + ["a " * 50, "b a " * 30]
    want = sorted((d, i, c) for d, t in enumerate(texts) for i, (_, s) in enumerate(items) for c, n in [tiles(t, s)] if c and 100 * c >= string_tiling.PERCENT * n)
    for chunk in (1, 7, string_tiling.CHUNK):
        monkeypatch.setattr(string_tiling, "CHUNK", chunk)
        assert sorted(string_tiling.Items(items).tiled(Words([t.encode() for t in texts], space=PUNCTUATION))) == want and len(want) > 100
    monkeypatch.undo()
    big = string_tiling.Items([(1, "word " * 240), (2, "word " * 200 + "other text that is not there " * 10)])
    tracemalloc.start()
    found = big.tiled(Words([b"word " * 100_000], space=PUNCTUATION))  # 44 million pairs of places
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 240), (0, 1, 200)] and peak < 250e6


def test_tiling_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, QUERIES["op7_decontamination"](spark, SF).collect()))
    monkeypatch.setattr(string_tiling, "BLOCK_CHARS", 20_000)
    assert sorted(map(tuple, string_tiling.contaminated_pairs(docs, bench).collect())) == want and want
    items = {r.item_id: r.text for r in bench.collect()}
    assert all(items[i] in t for d, t in ((r.doc_id, r.text) for r in docs.collect()) for w, i, _, c in want if w == d and c == len(tokens(items[i])) and items[i] in t)


# --- pipeline ---------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as P
    import sentencepiece

    from deckscope.llm.queries import tokenizer_path

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = set(QUERIES["op10_quality_rules"](spark, SF).where("kept").select("doc_id").toPandas()["doc_id"])
    texts = {i: t for i, t in docs.items() if i in kept}
    texts = {i: t for i, _, _, t in brute.line_dedup(list(texts.items()))}
    texts = {i: t for i, t in texts.items() if brute.components(list(texts.items()))[i][1] == i} if len(texts) < 5 else (lambda c: {i: t for i, t in texts.items() if c[i][1] == i})(brute.components(list(texts.items())))
    grams = [(set(zip(*(tokens(b)[k:] for k in range(5)), strict=False)), b) for b in bench]

    def leaked(t):
        mine = set(zip(*(tokens(t)[k:] for k in range(5)), strict=False))
        return any(g & mine and (lambda c, n: 100 * c >= string_tiling.PERCENT * n)(*tiles(t, b)) for g, b in grams)

    texts = {i: t for i, t in texts.items() if not leaked(t)}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in P.run(spark, SF).collect()}
    assert got == {i: library.encode(t) for i, t in texts.items()}
    assert len(P.STAGES) == 5 and 0 < len(got) < len(docs)


def test_pipeline_near_duplicates_by_row(spark):
    """An id with two texts, copies under one id, copies without an id: one row of each group stays, and no other goes."""
    import corpus_pipeline as P

    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, words("a"), "x"), (2, words("a"), "x"), (2, words("b"), "x"), (3, words("c"), "x"), (3, words("c"), "x"), (None, words("d"), "x"), (None, words("d"), "x"),
            (None, words("a"), "x"), (9, words("e") + " end", "x"), (8, words("e"), "x"), (4, "", "x"), (4, "", "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _row", "2 as component_id").repartition(3)
    out = P.near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    want = [(1, words("a")), (2, words("b")), (3, words("c")), (None, words("d")), (8, words("e")), (4, ""), (4, ""), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as P

    df = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, f in P.STAGES[:-1]:
        df2 = f(spark, df, SF)
        assert df2.columns == df.columns and df2.schema.simpleString() == df.schema.simpleString()
        assert f(spark, df.limit(0), SF).count() == 0
    assert P.STAGES[-1][1](spark, df.limit(0), SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], df.schema)
    for _, f in P.STAGES:
        f(spark, odd, SF).collect()
    assert F is not None
