"""The rule index finds exactly what running every rule on every line finds."""

import random

import pytest

from keysieve import DEFAULT_RULES
from keysieve.operators import rule_index, skew
from keysieve.operators.matching import match_lines
from keysieve.sources.rules import Rule

RULES = [
    Rule(1, r"\bpassword\b", "x", ""), Rule(2, r"(?:passwords?|secret)\s*=", "x", ""), Rule(3, r"[0-9]{4}", "x", ""),
    Rule(4, r"key", "x", ""), Rule(5, r"apikey[a-z]+", "x", ""), Rule(6, r"(abc|abcdefghij|zz.yyy)", "x", ""), Rule(7, r"a.b", "x", ""),
    Rule(8, r"disk size", "x", ""), Rule(9, r"^token$", "x", ""), Rule(10, r"\bKEY\b", "x", ""), Rule(11, r"x{3}secret", "x", "")]


def pairs(frame):
    return sorted((r.n, r.rule_id, r.match_end) for r in frame.collect())


@pytest.fixture
def lines(spark):
    rng = random.Random(2)
    words = ["password", "PassWord", "passwords=", "ſecret =", "secret=", "KEY", "apikeyx", "abcdefghij", "zz yyy", "zzzyyy", "2024", "DİSK SIZE",
             "dısk ſize", "disk size", "token", "ab", "acb", "é", "", "xxxsecret", "KEY", "ȧb", "keyé"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(1500)]
    rows += [(1500, None), (1501, "token\n"), (1502, "x" * 100_000 + " password"), (1503, "token")]
    return spark.createDataFrame(rows, "n int, match_text string")


@pytest.mark.parametrize("small", [True, False])
def test_index_equals_every_rule(lines, monkeypatch, small):
    if not small:
        monkeypatch.setattr(skew, "is_small", lambda *a, **k: False)
    expected = pairs(match_lines(lines, RULES, every_rule=True))
    assert len({r for _, r, _ in expected}) == len(RULES)
    assert pairs(rule_index.match_many(lines, RULES)) == expected
    best = rule_index.best_rules(rule_index.match_many(lines, RULES), ["n"])
    assert sorted((r.n, r.rule_id) for r in best.collect()) == sorted((r.n, r.rule_id) for r in match_lines(lines, RULES).collect())


def test_only_plain_or_only_indexed_rules(lines):
    for rules in ([RULES[2]], [RULES[0]], DEFAULT_RULES):
        assert pairs(rule_index.match_many(lines, rules)) == pairs(match_lines(lines, rules, every_rule=True))
    assert rule_index.match_many(lines.limit(0), RULES).isEmpty()


def test_grams():
    grams, plain = rule_index.gram_index(RULES)
    assert {r.id for r in plain} == {3, 7} and {i: len(c) for i, c in grams.items() if len(c) > 1} == {2: 2, 6: 2}
    shared, _ = rule_index.gram_index([Rule(1, "commonpart1", "x", ""), Rule(2, "commonpart2", "x", "")])
    assert shared[1] != shared[2]                     # the part that tells two literals apart is taken
