"""Cases that earlier rounds got wrong: letters, long learning texts, articles in odd places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import html_extraction, language_id
from keysieve.llm.html_extraction import Line, content_lines, main_text

LONG = ("A long sentence of the article that goes on and on, as articles do. " * 4).strip()


def test_only_letters_make_words(spark):
    assert [language_id.words_of(t) for t in ("½", "²", "Ⅷ ①", "a½ É", None, "")] == [[], [], [], ["a½", "é"], [], []]
    model = language_id.fit_field([("en", "the and of"), ("fr", "le et de")])
    docs = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ"), (3, "the")], "doc_id long, text string")
    got = {r["doc_id"]: r["language"]["lang"] for r in language_id.identify(docs, model).collect()}
    assert got == {1: "und", 2: "und", 3: "en"}


def test_long_and_repeated_texts_are_learned_from(spark):
    model = language_id.Field(rows=5, chars=50)
    rows = [(1, "wort " * 100, "de")] + [(7, "same words", "en")] * 500 + [(None, "null id", "fr"), (9, None, "xx"), (10, "", "xx"), (11, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.learning_rows(docs, F.lit(True), "text", "lang", "doc_id", model)
    assert [f for f in found if f[0] != "de"] == [("en", "same words"), ("fr", "null id")]
    assert sum(f[0] == "de" for f in found) == 5 and all(len(t) == 50 for x, t in found if x == "de")
    again = docs.unionAll(docs).repartition(5)
    assert language_id.learning_rows(again, F.lit(True), "text", "lang", "doc_id", model) == found
    assert language_id.learning_rows(docs.limit(0), F.lit(True), "text", "lang", "doc_id", model) == []


@pytest.mark.parametrize("page, text", [
    ("<article class='post related-posts-on'><h1>T</h1><p>x y z</p></article>", "T\nx y z"),
    (f"<div id=content><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><article>Teaser</article>", f"Title\n{LONG}\n{LONG}"),
    (f"<h1>Title</h1><p>Short intro.</p><p>{LONG}</p><p>{LONG}</p>", f"Title\nShort intro.\n{LONG}\n{LONG}"),
    (f"<h1>Title</h1><div>By Ann</div><p>{LONG}</p><p>{LONG}</p>", f"Title\nBy Ann\n{LONG}\n{LONG}"),
    (f"<h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p></article>", f"Title\n{LONG}\n{LONG}"),
    ("<article><p>A <math>x</math> and <label>label</label> word <button>Btn</button> <object>ob</object> end</p></article>",
     "A x and label word Btn ob end"),
    (f"<p>{LONG}</p><p><a href=x>{LONG}</a></p><p>{LONG}</p>", f"{LONG}\n{LONG}\n{LONG}"),
    (f"<p>{LONG}</p><p>{LONG}</p><form>Mail <label>you</label><input><button>Send</button></form>", f"{LONG}\n{LONG}")])
def test_articles_in_odd_places(page, text):
    assert main_text(f"<body>{page}") == text


def test_smoothing_and_clusters_against_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    differs = 0
    for _ in range(200):
        lines = [Line("x" * int(n), int(t), 0, bool(k < 0.2), "p" if k < 0.1 else "div")
                 for n, t, k in zip(rng.choice([3, 20, 200], 12), rng.integers(1, 5, 12), rng.random(12))]
        ratios = [len(x.text) / x.tags for x in lines]
        smooth = []
        for i in range(12):
            w = [np.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 2 else 0 for j in range(12)]
            smooth.append(sum(a * b for a, b in zip(w, ratios)) / sum(w))
        limit = min(np.std(smooth), np.mean(smooth))
        first = [i for i in range(12) if smooth[i] >= limit and not lines[i].links]
        want = [i in first or (bool(first) and first[0] < i < first[-1] and (not lines[i].links or lines[i].block == "p")) for i in range(12)]
        assert content_lines(lines) == want
        with monkeypatch.context() as patched:
            patched.setattr(html_extraction, "smoothed", lambda values, radius: values)
            differs += content_lines(lines) != want
    assert differs > 50                     # without the smoothing other lines are taken


def test_deep_and_long_pages():
    deep = "<div>" * 30_000 + "x" + "</b>" * 30_000 + "</div>" * 30_000
    assert main_text(deep + f"<p>{LONG}</p>" * 2000).count(LONG) == 2000
