"""Quality rules, quality scores, language, pages and urls on small inputs, against plain Python where that exists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import language_id, quality_classifier, quality_rules, url_filters
from keysieve.llm.common import split_words
from keysieve.llm.html_extraction import extract_main_text, main_text

WORDS = ["alpha", "beta", "über", "delta", "eps"]


def brute_repeats(words):
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_repeated_words_against_brute_force():
    rng = random.Random(1)
    for n in [0, 1, 4, 5, 6, 7, 40, 90]:
        words = [rng.choice(WORDS[:2]) for _ in range(n)]
        assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_counts_of_a_text():
    text = "a# b\n\n a# b\na# b\n \n \n"
    assert quality_rules.count_text(text) == (8, 11, 3, 5, 2, 0)
    assert quality_rules.count_text(None) == quality_rules.count_text("") == (0, 0, 0, 0, 0, 0)
    assert split_words("\x1ca\tb\r\n c ") == ["\x1ca", "b", "c"]


def test_rules_reject_and_hosts_shrink(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "bad", "x") for i in range(40)] + [(100 + i, "good", good) for i in range(40)]
    rows += [(200, "bad", good), (201, "bad", good + " ####"), (202, "good", good + " ####"), (203, None, None), (204, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert not got[0]["kept"] and got[100]["kept"] and got[200]["kept"]      # a clean document of a bad host stays
    assert not got[201]["kept"] and got[202]["kept"]                          # a suspect one doesn't
    assert not got[203]["kept"] and got[203]["base_failed"] and not got[204]["kept"]
    assert got[0]["host_rate"] < 1 and got[100]["host_rate"] > 0
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and {r["kept"] for r in left.collect()} == {"clash"}
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_scores_on_kept_aside_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = [rng.choice("the of and to in a is that for it".split()) + rng.choice("xyz") * (i % 3) for _ in range(60)]
        rows.append((i, " ".join(words) if i % 4 else " ".join(w + "###" for w in words)))
    rows += [(1000, None), (1001, ""), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(3, 1), (7, None)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    aside = [r for r in got if r["doc_id"] % 5 == 0 and r["doc_id"] < 400]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 > 0) for r in aside]) > 0.95
    none = quality_classifier.classify(docs, labels.limit(0), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_normal_equations_and_calibration_out_of_fold_against_brute_force(spark):
    rng = np.random.default_rng(5)
    width = len(quality_classifier.statistics(""))
    x = rng.normal(size=(300, width))
    y = (rng.random(300) < 0.5).astype(float)                # labels that nothing explains
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "stats array<double>, label double")
    model = quality_classifier.fit(rows, quality_classifier.Classifier(ridge=1e-2))
    z = model.fourier(x)
    penalty = 1e-2 * 300 * np.eye(z.shape[1]) / z.shape[1] + 1e-9 * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    # The ridge fits its own rows well; levels learned on them would be sure of themselves.
    score = model.score(x)
    assert np.mean((model.raw(x) > 0.5) == (y > 0.5)) > 0.8
    assert np.mean((score > 0.1) & (score < 0.9)) > 0.8


def test_isotonic_is_optimal_against_the_formula_of_minima_and_maxima():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9):
        v, w = rng.normal(size=n), rng.integers(1, 5, n)
        mean = lambda a, b: np.average(v[a:b + 1], weights=w[a:b + 1])
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(quality_classifier.isotonic(v, w), want)


def test_calibration_keeps_ranks_and_shares():
    at, ones, count = np.linspace(0, 1, 6), np.array([0.0, 30, 20, 60, 50, 100]), np.full(6, 100.0)
    knots, levels = quality_classifier.centred(at, ones, count)
    assert np.allclose(knots, [-0.5, 0, 0.3, 0.7, 1, 1.5]) and np.all(np.diff(levels) > 0)
    assert np.allclose(levels, [0, 0.5 / 101, 50.5 / 201, 110.5 / 201, 100.5 / 101, 1])


def test_isotonic_is_monotone_and_optimal_on_a_known_case():
    assert list(quality_classifier.isotonic(np.array([1.0, 3, 2, 4]), np.ones(4))) == [1, 2.5, 2.5, 4]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    scores, move = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    lengths = np.array([1, 6, 4])
    got, pairs = language_id.forward_backward(scores, lengths, move, segment=3)
    at, total = 0, np.zeros((2, 2))
    for n in lengths:
        weight, chance, moves = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2 ** n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            weight += p
            for i in range(n):
                chance[i, y[i]] += p
            for a, b in zip(y, y[1:]):
                moves[a, b] += p
        assert np.allclose(got[at:at + n], chance / weight)
        total += moves / weight
        at += n
    assert np.allclose(pairs, total)


def test_language_of_words_and_documents(spark):
    rng = random.Random(3)
    vocabulary = {"en": "the house and which nothing with this water".split(), "de": "der und nicht haus wasser mit dieser über".split()}
    line = lambda lang, n=8: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    model = language_id.fit_field([(k, "\n".join(line(k) for _ in range(6))) for k in ("en", "de") for _ in range(30)])
    docs = spark.createDataFrame([(1, line("en")), (2, line("de")), (3, None), (4, ""), (5, "123 !"), (6, line("en", 9) + " " + line("de", 4)),
                                  (7, line("de", 3000))], "doc_id long, text string")
    got = {r["doc_id"]: r["language"] for r in language_id.identify(docs, model).collect()}
    assert [got[i]["lang"] for i in (1, 2, 6, 7)] == ["en", "de", "en", "de"]
    assert all((got[i]["lang"], got[i]["score"], got[i]["runs"]) == ("und", 0.0, []) for i in (3, 4, 5))
    assert [(r["lang"], r["words"]) for r in got[6]["runs"]] == [("en", 9), ("de", 4)]
    nothing = language_id.fit_field([])
    assert {r["language"]["lang"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp;  line</h1><p>First <b>bold</b> text,
goes on.<p>Second &lt;para&gt;.</p><div class="share">Tweet</div><script>var p="</p>";</script><aside>Also read</aside>
<p>Short.</p></article><section id="comments"><article class="comment"><p>Great post, thanks a lot for it!</p></article></section>
<form><input><button>Send</button></form><footer>&copy; us</footer>"""


def test_main_text_of_pages(spark):
    want = "Head & line\nFirst bold text, goes on.\nSecond <para>.\nShort."
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p></p>")], "page_id long, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("", 0)}
    long = "A long sentence of the article that goes on and on, as articles do. " * 4
    plain = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><p>{long}</p><p>Yes.</p><p>{long}</p><div><a href=c>Three</a></div>"
    assert main_text(plain) == "\n".join([long.strip(), "Yes.", long.strip()])


def test_wrappers_of_the_content_are_kept():
    long = ("A long sentence of the article that goes on and on, as articles do. " * 4).strip()
    body = f"<h1>Title</h1><p>{long}</p><p>Yes.</p>"
    side = "<div class='sidebar'><p>Most read today</p></div><div id=comments><article><p>Great post!</p></article></div>"
    for name in ("site has-sidebar", "content no-sidebar", "page with-menu", "elementor-widget-text-editor", "widget"):
        assert main_text(f"<body><div class='{name}'><article>{body}</article></div>{side}") == f"Title\n{long}\nYes."
        assert main_text(f"<body><div class='{name}'><p>{long}</p><p>{long}</p></div>{side}") == f"{long}\n{long}"
    more = f"<div><p>{long * 9}</p></div>"
    assert main_text(f"<body>{more}<div class='banner'><article>{body}</article></div>") == f"Title\n{long}\nYes."
    assert main_text(f"<body><article><div class='article-header'><h1>Title</h1></div><p>{long}</p></article>") == f"Title\n{long}"
    page = f"<form><input type=hidden><div><input><button>Search</button></div><p>{long}</p><p>{long}</p></form>"
    assert main_text(f"<body>{page}") == f"{long}\n{long}"
    assert main_text(f"<body><p>{long}</p><form>Your mail <input><button>Send</button></form><p>{long}</p>") == f"{long}\n{long}"
    links = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"
    assert main_text(f"<body><article><p>{long}</p>{links}</article>") == f"{long}\nOne\nTwo"
    teaser = "<div class='sidebar'><article><p>Teaser</p></article></div>"
    assert main_text(f"<body><article>{body}</article>{teaser}") == f"Title\n{long}\nYes."


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


@pytest.mark.parametrize("url, host, path, rule", [
    ("https://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
    ("http://example.com", "example.com", "", None), ("http://xexample.com/en/", "xexample.com", "/en/", "com/"),
    ("http://a.net/es/1://b/c", "a.net", "/es/1://b/c", "net/es/"), ("http://a.net?x/es/", "a.net", "", None),
    ("no scheme", "", "", None), (None, "", "", None)])
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    rows = spark.createDataFrame([(url,)], "url string")
    judged = rows.select(url_filters.host_of().alias("h"), url_filters.path_of().alias("p"))
    got = judged.select("h", "p", url_filters.rule_of(F.col("h"), F.col("p"), RULES).alias("r")).first()
    assert tuple(got) == (host, path, rule)


def test_url_models_tell_what_the_rules_taught(spark):
    rows = [(i, f"http://good{i % 7}.com/story/{i}") for i in range(200)] + [(i, f"http://casino{i % 7}.net/es/win/{i}") for i in range(200, 400)]
    rows += [(900, "http://good9.org/story/77"), (901, "http://casino9.org/win/77"), (902, None), (903, "http://good9.org/story/77")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filters.judge_urls(pages, RULES).collect()}
    assert len(got) == len(rows) and got[0]["verdict"] == "allow" and got[300]["verdict"] == "block"
    assert got[900]["verdict"] == got[903]["verdict"] == "allow" and got[901]["verdict"] == "block"
    assert got[902]["host"] == "" and got[902]["verdict"] in ("allow", "block")
    assert url_filters.judge_urls(pages.limit(0), RULES).count() == 0


def test_url_scores_against_brute_force_on_many_grams(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(12))
    rows = [(f"http://h{i % 9}.org/{word()}/{word()}" + ("/win" if i % 2 else ""), i % 2 == 0) for i in range(3000)]
    marked = lambda u: "\2" * 5 + "".join("0" if c.isdigit() else c for c in u.split("://")[1]) + "\3"
    grams = lambda u, k: [marked(u)[i - k:i + 1] for i in range(5, len(marked(u)))]
    chance, ratios = {}, []
    for k in range(6):
        counts = {}
        for u, ok in rows:
            for g in grams(u, k):
                counts.setdefault(g, [0, 0])[not ok] += 1
        seen = {}
        for g, n in counts.items():
            of = seen.setdefault(g[:-1], [0, 0, 0, 0])
            for s in (0, 1):
                of[s] += n[s]
                of[2 + s] += n[s] > 0
        chance = {g: [(n[s] + (seen[g[:-1]][2 + s] + 1) * (chance[g[1:]][s] if k else 1 / 128))
                      / (seen[g[:-1]][s] + seen[g[:-1]][2 + s] + 1) for s in (0, 1)] for g, n in counts.items()}
        ratios.append({g: np.log(p[0] / p[1]) for g, p in chance.items() if sum(counts[g]) >= (2 if k else 1)})
    assert len(counts) > 65_536

    def score(u):
        ends = [next((r[g[5 - k:]] for k, r in reversed(list(enumerate(ratios))) if g[5 - k:] in r), 0.0) for g in grams(u, 5)]
        return np.mean(ends)

    models = url_filters.fit_models(spark.createDataFrame(rows, "url string, ok boolean"), "url", F.col("ok"))
    others = [f"http://h{i % 9}.org/{word()}/q~" for i in range(400)]
    got = url_filters.score_urls(spark.createDataFrame([(u,) for u in others + [rows[0][0], rows[1][0]]], "url string"), "url", models)
    got = {r["url"]: r["score"] for r in got.collect()}
    assert len(got) == 402 and max(abs(got[u] - score(u)) for u in got) < 1e-9
