import html
import re
import time
import zlib
from itertools import product

import numpy as np
import pytest

from helixframe.llm.html_text import Weights, best_region, container_key, extract_text, fit_weights, label_counts, main_text
from helixframe.llm.langid import ORDER, REJECT, UNSEEN, Classifier, Model, fit_languages, identify, op6_langid
from helixframe.llm.quality import AttentionModel, fit_quality, op10_quality, score_quality
from helixframe.llm.registry import QUERIES
from helixframe.llm.toxicity import fit_ftrl, fit_toxicity, labelled_sample, op5_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def area(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    ones = labels == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("query, label, modulus, held, least", [(op5_toxicity, "toxic", 4, 2, 0.9), (op10_quality, "quality", 5, 0, 0.97)])
def test_held_out_accuracy(spark, query, label, modulus, held, least):
    found = {r["doc_id"]: r for r in query(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    rows = [(r[label], found[r["doc_id"]]) for r in labels]
    assert all(f["held_out"] == (fold(f["doc_id"], modulus) == held) for f in found.values())
    assert all(0 <= f["score"] <= 1 and f["predicted"] == (f["score"] >= 0.3) for f in found.values())
    own = [(y, f["score"]) for y, f in rows if f["held_out"]]
    assert area(np.array([y for y, _ in own]), np.array([s for _, s in own])) >= least


def test_held_out_languages(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    own = [r for r in op6_langid(spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in own]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in own)


def test_rejection_is_about_what_its_name_says(spark):
    """Of held-out rows of the larger table, within a factor of two; the calibrating texts are others."""
    own = [r for r in op6_langid(spark, "/root/testdata/sf0.1").select("held_out", "rejected").collect() if r["held_out"]]
    assert (1 - REJECT) / 2 <= np.mean([r["rejected"] for r in own]) <= 2 * (1 - REJECT)


def plain_kneser_ney(words, order, unseen):
    """p(character, what is before it in its word), by the definition; words: word and how often."""
    seen = {n: {} for n in range(1, order + 1)}
    for w, k in words.items():
        w = f" {w} "
        for n in seen:
            for i in range(1 if n == 1 else 0, len(w) - n + 1):
                seen[n][w[i : i + n]] = seen[n].get(w[i : i + n], 0) + k

    def count(gram):
        n = len(gram)
        before = [g for g in seen.get(n + 1, ()) if g[1:] == gram] if n < order else []
        return len(before) or seen[n].get(gram, 0)

    discounts = {}
    for n in seen:
        of = [count(g) for g in seen[n]]
        discounts[n] = of.count(1) / (of.count(1) + 2 * of.count(2)) if 1 in of and 2 in of else 0.5

    def p(c, before):
        n = len(before) + 1
        after = [count(g) for g in seen[n] if g[:-1] == before]
        lower = p(c, before[1:]) if n > 1 else unseen
        if not after or (n == 1 and c not in seen[1]):
            return lower
        return max(count(before + c) - discounts[n], 0) / sum(after) + discounts[n] * len(after) / sum(after) * lower

    return p


def test_scores_are_those_of_plain_kneser_ney():
    rng = np.random.default_rng(3)
    draw = lambda letters: {"".join(rng.choice(list(letters), rng.integers(1, 8))): int(rng.integers(1, 4)) for _ in range(40)}
    languages = [draw("abcd"), draw("bcdefé")]
    grams = {}
    for lang, words in enumerate(languages):
        for w, k in words.items():
            w = f" {w} "
            for n in range(1, ORDER + 1):
                for i in range(1 if n == 1 else 0, len(w) - n + 1):
                    own = grams.setdefault(n, {})
                    own[lang, w[i : i + n]] = own.get((lang, w[i : i + n]), 0) + k
    asked = list(languages[0])[:15] + list(languages[1])[:15] + ["abz", "é", "dcba", "ffff", "zz"]
    found = Model(["x", "y"], grams).word_scores(asked)
    for lang, words in enumerate(languages):
        p = plain_kneser_ney(words, ORDER, UNSEEN)
        whole = [f" {w} " for w in asked]
        want = [sum(np.log(p(w[i], w[max(0, i - ORDER + 1) : i])) for i in range(1, len(w))) for w in whole]
        assert np.allclose(found[:, lang], want, rtol=1e-4)


def test_probabilities_sum_to_one():
    """Over all words of up to 7 letters from the training alphabet; longer ones and unseen characters have the rest."""
    grams = {}
    for w, k in {"anna": 3, "nan": 2, "ann": 1, "a": 4}.items():
        w = f" {w} "
        for n in range(1, 5):
            for i in range(1 if n == 1 else 0, len(w) - n + 1):
                own = grams.setdefault(n, {})
                own[0, w[i : i + n]] = own.get((0, w[i : i + n]), 0) + k
    model = Model(["x"], grams)
    words = ["".join(p) for n in range(1, 13) for p in product("an", repeat=n)]
    total = np.exp(model.word_scores(words)[:, 0].astype(float)).sum()
    assert 0.9 < total <= 1.0001


def test_language_edge_cases(docs, empty):
    model = fit_languages(docs.select("doc_id", "text", "lang"))
    found = identify(docs, model).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    none = fit_languages(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in identify(docs, none).collect()} == {"und"} and identify(empty, none).count() == 0
    assert Classifier(none).predict([])[0] == []


def test_letters_are_those_of_unicode(spark):
    docs = spark.createDataFrame([(i, t, l) for i in range(60) for t, l in ((f"hello there {'abc'[i % 3]}", "en"), (f"hola amigo {'abc'[i % 3]}", "es"))], "doc_id long, text string, lang string")
    model = fit_languages(docs)
    asked = spark.createDataFrame([(1, "½ ²"), (2, "①②"), (3, "Ⅷ _ 12"), (4, "ª 1"), (5, "hola"), (6, "\u0301")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in identify(asked, model).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True}


def test_more_languages_than_any_cap(spark):
    words = [f"{a}{b}{c}" for a in "bcdfghjk" for b in "aeiouyäö" for c in "lmnprstvwxz"][:700]
    rows = [(i * 3 + k, f"{w} {w}{w} {w}", w) for i, w in enumerate(words) for k in range(3)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    known = {w for i, w in enumerate(words) if any(fold(i * 3 + k, 4) != 2 for k in range(3))}
    assert set(model.languages) == known and len(known) > 512
    names = Classifier(model).predict([f"{w} {w}{w} {w}" for w in sorted(known)])[0]
    assert names == sorted(known)


def test_discounts_are_of_each_language():
    grams = {n: {(0, "a" * n): 9, (0, "b" * n): 1, (0, "c" * n): 2} for n in range(1, 5)}
    alone = Model(["x"], grams).word_scores(["ab", "cc"])[:, 0]
    other = {n: own | {(1, chr(100 + i) * n): 1 for i in range(20)} for n, own in grams.items()}
    assert np.allclose(Model(["x", "y"], other).word_scores(["ab", "cc"])[:, 0], alone)


def test_labelled_rows_are_at_most_the_bound(spark):
    docs = spark.createDataFrame([(i // 3, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 100, i % 2) for i in range(250)], "doc_id long, toxic int")
    for bound, n in ((1, 1), (7, 7), (1000, sum(fold(i, 4) != 2 for i in range(100)))):
        rows = labelled_sample(docs, labels, "toxic", 4, 2, bound).collect()
        assert len(rows) == len({r["doc_id"] for r in rows}) == n
        assert all(r["text"] == min(f"text {3 * r['doc_id'] + k}" for k in range(3)) for r in rows)


def test_words_reach_the_quality_model(spark):
    """Texts of equal shape that differ in words only."""
    rng = np.random.default_rng(5)
    good, bad = [f"k{i:03}" for i in range(40)], [f"q{i:03}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 80))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"))
    held = [(r["doc_id"], r["score"]) for r in score_quality(docs, model).collect() if fold(r["doc_id"], 5) == 0]
    assert area(np.array([i % 2 for i, _ in held]), np.array([s for _, s in held])) > 0.95


def test_toxicity_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 1), (7, 1, 0), (1, None, None), (99, 1, 1), (10, 0, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        model = fit_toxicity(docs, own)
        found = score_toxicity(docs, model)
        assert found.columns == [c for c in docs.columns if c != "score"] + ["score"] and found.count() == docs.count()
        assert all(0 <= r["score"] <= 1 for r in found.collect()) and score_toxicity(empty, model).count() == 0


def test_quality_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 1), (7, 0, 0), (1, None, None), (99, 1, 1), (10, 0, 1)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        model = fit_quality(docs, own)
        found = score_quality(docs, model)
        assert found.count() == docs.count() and all(0 <= r["score"] <= 1 for r in found.collect()) and score_quality(empty, model).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    model, x, start, y = AttentionModel(5), rng.normal(size=(7, 5)), np.array([0, 2, 3, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, start)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = model.gradient(model.forward(x, start), start, y)
    for k, p in model.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        keep = p[at]
        p[at] = keep + 1e-5
        up = loss()
        p[at] = keep - 1e-5
        down = loss()
        p[at] = keep
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_attention_finds_the_passage_that_matters():
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(rng.integers(1, 9), 6)) for _ in range(600)]
    y = rng.integers(0, 2, 600).astype(float)
    for b, one in zip(bags, y, strict=True):
        if one:
            b[rng.integers(len(b)), 0] += 6
    model = AttentionModel(6).fit(bags[:400], y[:400])
    scores = np.concatenate([model.forward(b, np.array([0, len(b)]))["score"] for b in bags[400:]])
    assert area(y[400:], scores) > 0.95


def plain_article(page):
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " "))).strip() for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    for r in extract_text(pages, fit_weights(pages)).collect():
        assert (r["text"], r["n_chars"]) == (want[r["page_id"]], len(r["text"]))


def test_page_edge_cases(spark, tables):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "plain < text & more"), (4, "u", "plain < text & more"), (None, "u", "<article><p>a&amp;b<br>c</p></article>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = sorted((str(r["page_id"]), r["text"]) for r in extract_text(pages, fit_weights(pages)).collect())
    assert found == [("1", ""), ("2", ""), ("3", ""), ("4", "plain < text & more"), ("4", "plain < text & more"), ("None", "a&b c")]


def test_other_layouts():
    w = Weights({})
    body = "word " * 30
    page = f"""<html><head><title>t</title></head><body><header><ul><li><a href=x>Home</a></li></ul></header><div class="cookie-notice">We use cookies</div>
    <main><h1>Head &amp; line</h1><p>{body}<a href='/'>link</a> end.</p><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul><p>Last <i>para</i>graph</p>
    <form><button>Send</button></form><section class="comments"><p>Nice article</p></section></main><aside><p>Related stuff</p></aside><footer>(c)</footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert main_text(page, w) == "\n\n".join(["Head & line", body.strip() + " link end.", "one", "two", "Last paragraph"])


def test_best_region():
    assert best_region([]) == (0, 0) and best_region([-1.0, -2.0]) == (0, 0)
    assert best_region([-1, 2, -1, 3, -5, 4]) == (1, 4)


def test_all_queries_on_empty_tables(spark, tables):
    for name, query in QUERIES.items():
        assert query(spark, tables).count() == 0, name


BODY = "word " * 30


@pytest.mark.parametrize(
    "start, end",
    [
        ('<div class="layout with-sidebar"><article>', "</article></div>"), ('<div class="no-sidebar"><article>', "</article></div>"), ('<form id="aspnetForm"><article>', "</article></form>"),
        ('<article class="post comments-open">', "</article>"), ('<article class="hentry category-social">', "</article>"), ('<article class="story-related-none">', "</article>"),
        ('<article class="sponsored">', "</article>"), ('<div class="sidebar"><main>', "</main></div>"), ('<main><form><article>', "</article></form></main>"), ('<form><nav>Home</nav><h1>A</h1><div>', "</div></form>"),
    ],
)
def test_wrappers_and_names_of_articles(start, end):
    found = main_text(f"<html><body>{start}<p>{BODY}</p>{end}</body></html>", Weights({}))
    assert found.removeprefix("A\n\n") == BODY.strip()


def test_articles_that_are_comments_or_teasers():
    teaser, comment = "<article><p>Another story of some words</p></article>", '<section class="comments"><article class="comment"><p>Nice one</p></article></section>'
    for page in (
        f"<article><p>{BODY}</p>{comment}</article><aside>{teaser}</aside>", f"<main><p>{BODY}</p><aside>{teaser}</aside></main>", f'<article><p>{BODY}</p></article><div class="related-posts">{teaser}</div>',
        f"<form><article><p>{BODY}</p></article><aside>{teaser}</aside></form>", f"<main><p>{BODY}</p><div class='comment-list'>x y</div><div class='site-footer'>z</div></main>",
    ):
        assert main_text(f"<html><body>{page}</body></html>", Weights({})) == BODY.strip()


@pytest.mark.parametrize("start, end", [('<article id="post-17">', "</article>"), ('<div class="post-content">', "</div>"), ('<main><div id="x">', "</div></main>")])
@pytest.mark.parametrize("block", ['<div class="share">Send this to all your friends</div>', '<aside class="ad">Buy one and get another for free today</aside>', '<nav>Up and down and left and right</nav>'])
def test_headline_and_end_round_bars(start, end, block):
    head, last = "Eight words that stand over an article here", "Two words"
    page = f"<html><body>{start}<h1>{head}</h1>{block}<p>{BODY}</p>{block}<p>{last}</p>{end}</body></html>"
    assert main_text(page, Weights({})) == f"{head}\n\n{BODY.strip()}\n\n{last}"


def test_weights_learned_for_ids_that_were_not_sampled():
    w = Weights({})
    for i in range(40):
        for (what, name, within), n in label_counts(f'<main><div class="item-{i}" id="p-{i}">{BODY}</div></main><div class="lead-{i}">{BODY}</div>').items():
            if what == "word":
                w.words[name] = (4.0 if within else -4.0, w.words.get(name, (0, 0))[1] + n)
    same = [[w.container(container_key(tag, f' class="{c}{i}" id="q-{i}"')) for i in (3, 999)] for tag, c in (("div", "item-"), ("div", "lead-"), ("main", "x"), ("article", "y"))]
    assert all(a == b for a, b in same) and same[0][0] > 3 and same[1][0] < -3 and same[2][0] > 3


@pytest.mark.parametrize("start", ["<head><meta charset=utf-8><title>t</title>", "<head><title>t</title><noscript><link rel=x></head>", "<head><template><i>x</i>", ""])
@pytest.mark.parametrize(
    "part",
    [
        "", "<div><svg><path d='M0'><title>s</title></div>", "<svg viewBox='0'>", "<svg/>", "<div><noscript><img src=x></div>", "<div><iframe src=x></div>", "<p><math><mi>x</mi></p>", "<span><template><b>x</b></span>",
        "<template><template>x</template><p>y</template>", "<svg><foreignObject><p>x</p></foreignObject></svg>", "<iframe>x</iframe><noscript><p>x</p></noscript>",
    ],
)
def test_elements_that_are_left_open(start, part):
    page = f"<html>{start}<body><article><h1>Head</h1>{part}<p>{BODY}</p><p>End</p></article></body></html>"
    assert main_text(page, Weights({})) == f"Head\n\n{BODY.strip()}\n\nEnd"


def test_toxicity_is_one_fit_at_every_size(spark):
    """8,400 labelled rows, of which seven have a rare toxic word."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(40)])
    toxic = np.arange(14_000) % 10 == 0
    texts = [" ".join(rng.choice(words, 6)) + (" vile" if t else "") for t in toxic]
    trained = [i for i in range(14_000) if fold(i, 4) != 2]
    assert 8_400 < len(trained) < 16_000
    for i in [i for i in trained if not toxic[i]][:: len(trained) // 7][:7]:
        texts[i], toxic[i] = "zorblax", True
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    found = fit_toxicity(docs, labels)
    want = fit_ftrl([texts[i] for i in trained], np.array([float(toxic[i]) for i in trained]))
    assert found[0].tolist() == want[0].tolist() and np.allclose(found[1], want[1], atol=1e-5) and abs(found[2] - want[2]) < 1e-9


def test_tags_of_any_quotes():
    w, end = Weights({}), "</article><nav>Menu</nav>"
    for start in ("<p title=it's>", '<p title="a > b">', "<p x='\"'>", '<p x="a>', "<p x=a'b\"c>", '<p "x" y>', "<p x=>", "<p x =  'y'>"):
        assert main_text(f"<article>{start}{BODY}</p>{end}", w) == BODY.strip(), start
    assert main_text(f"<article><p>press <button>OK</button> now</p><p>{BODY}</p><blockquote>q<footer>by X</footer></blockquote>{end}", w) == f"press OK now\n\n{BODY.strip()}\n\nq\n\nby X"


@pytest.mark.parametrize("part", ["<div>", '<a b="><a" ', '<p x="a', "<form><h1>x", "<svg><g>", "<!", "<title>", "<ul></div>", "</p>", "<b", "&amp"])
def test_long_malformed_pages(part):
    """Work grows in proportion to a page's length; so does what of it is looked at."""
    page = "<article><p>first words</p>" + part * (400_000 // len(part))
    began = time.process_time()
    assert main_text(page, Weights({})).startswith("first words")
    assert time.process_time() - began < 8


def test_pages_without_article_elements(spark):
    """Class names without a prior are learned from pages that have an article and hold on pages without."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{rng.integers(900)}" for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        lead, text, tail = say(12), say(60), say(15)
        kind = "article" if i % 3 else "div"
        rows.append((i, "u", f'<body><div class="zork x{i}">{lead}</div><{kind} class="quux"><div class="inner y{i}"><p>{text}</p></div></{kind}><div class="zork">{tail}</div></body>'))
        want[i] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract_text(pages, fit_weights(pages)).collect()} == want


def test_page_sample_is_bounded_by_distinct_ids(spark):
    """Rows that repeat an id count once, so a bound is one of rows, too."""
    page = "<html><body><div class='menu'>one two</div><article><p>three words here</p></article></body></html>"
    once = [(i, "u", page) for i in range(30)]
    many = once + [(i % 3, "u", page) for i in range(600)] + [(0, "u", None)]
    one, two = (fit_weights(spark.createDataFrame(rows, "page_id long, url string, html string"), 30) for rows in (once, many))
    assert one.words == two.words and one.words
    few = fit_weights(spark.createDataFrame(many, "page_id long, url string, html string"), 5)
    assert {k: 6 * n for k, (_, n) in few.words.items()} == {k: n for k, (_, n) in one.words.items()}


def test_names_move_with_what_pages_show():
    """A listed name is a prior of as much weight as some words, not a veto."""
    w = Weights({("word", "div comment"): (5000, 0), ("word", "div zork"): (0, 5000)})
    assert w.is_not_content("div promo") and not w.is_not_content("div comment") and w.container("div zork") < -3
