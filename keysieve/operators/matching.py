"""Matching a rule catalogue against lines of text.

Every rule is a literal of the plan, so one pass over the lines evaluates the whole
catalogue without a join. Cheap tests keep most text away from the patterns: a rule is
only run where a literal it requires occurs, first on whole texts before they are
split, then on lines.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.sources.rules import Rule

try:
    from re import _parser
except ImportError:
    import sre_parse as _parser

# Caseless with Unicode folding and Unicode character classes; only a line feed ends a line.
FLAGS = "(?iduU)"
# Literals at least this long are rare enough to decide on their own.
TELLING = 3

_NAMED = re.compile(r"\(\?<[A-Za-z]")
_NOT_LOCAL = re.compile(
    r"\(\?(?!:)"              # lookaround, atomic group, inline flag, named group
    r"|[*+?}]\+"              # possessive quantifier
    r"|\\[1-9AZzGRXnrkQ]"     # reference, text anchor, explicit line break, quoting
    r"|[\r\n]|&&"
    r"|\)(?:[*+]|\{\d+,\})"   # unbounded repeat of a group: deep recursion on long text
)


_QUANTIFIER = re.compile(r"(?:(?:[*+?]|\{\d+(?:,\d*)?\})[+?]?)?")
# Atoms that do not stand for exactly one character.
_NO_CHARACTER = re.compile(r"[(^$|]|\\[bBAZzGRXkQE1-9]")


_CLASS = re.compile(r"\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", re.DOTALL)
_CLASS_PART = re.compile(r"\[:(\^?)(\w+):\]|\\.|.", re.DOTALL)


def java_dialect(regex: str) -> str:
    """A rule as Java reads it: inside a class, Java would take ``[`` and ``&&`` for set
    operations and does not know ``[:alpha:]``; named groups are written differently."""
    def part(match: re.Match) -> str:
        text = match.group()
        if match.group(2):
            return ("\\P" if match.group(1) else "\\p") + "{" + match.group(2).capitalize() + "}"
        return "\\" + text if text in ("[", "]", "&") else text

    def char_class(match: re.Match) -> str:
        text = match.group()
        if text[0] == "\\":
            return text
        start = "[^" if text[1] == "^" else "["
        return start + _CLASS_PART.sub(part, text[len(start):-1]) + "]"

    return _CLASS.sub(char_class, regex).replace("(?P<", "(?<")


def _java_rules(rules: Sequence[Rule]) -> list[Rule]:
    return [rule._replace(regex=java_dialect(rule.regex)) for rule in rules]


def java_pattern(regex: str) -> str:
    return f"{FLAGS}(?:{regex})"


_LONG_ESCAPE = re.compile(r"\\[pPxuckNQEgG0-9]")


def _atoms(regex: str) -> list[tuple[str, str]]:
    """The top level of a pattern as (atom, quantifier) pairs; a group or class is one
    atom."""
    atoms = []
    i = 0
    while i < len(regex):
        start, depth, in_class = i, 0, False
        while True:
            char = regex[i]
            i += 2 if char == "\\" else 1
            if in_class:
                in_class = char != "]" or regex[i - 2:i - 1] == "[" or regex[i - 3:i - 1] == "[^"
            elif char == "[":
                in_class = True
            else:
                depth += (char == "(") - (char == ")")
            if i >= len(regex) or (depth <= 0 and not in_class):
                break
        quantifier = _QUANTIFIER.match(regex, i).group()
        atoms.append((regex[start:i], quantifier))
        i += len(quantifier)
    return atoms


def _shortened(atoms: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Drop what the first atom repeats beyond its least number of times.

    Where one character class is repeated at the edge of a pattern, a match exists
    exactly if one exists with the fewest repeats. Long runs of such characters would
    otherwise be walked again from each of their characters.
    """
    while atoms:
        (atom, quantifier), rest = atoms[0], atoms[1:]
        if not quantifier or _NO_CHARACTER.match(atom) or len(quantifier) > 1 and quantifier[-1] == "+":
            return atoms
        digits = re.match(r"\{(\d+)", quantifier)
        least = int(digits.group(1)) if digits else int(quantifier[0] == "+")
        if least:
            return [(atom, "" if least == 1 else f"{{{least}}}"), *rest]
        atoms = rest
    return atoms


def existence_pattern(regex: str) -> str:
    """A pattern that is found in the same texts, but need not match as much of them.

    A pattern with an escape of more than one character stays as it is.
    """
    if _LONG_ESCAPE.search(regex):
        return regex
    atoms = _atoms(regex)
    if any(atom == "|" for atom, _ in atoms) or "".join(a + q for a, q in atoms) != regex:
        return regex
    atoms = _shortened(atoms)
    return "".join(a + q for a, q in _shortened(atoms[::-1])[::-1])


def _without_anchors(regex: str) -> str:
    """The pattern with its ``^`` and ``$`` assertions taken out; the callers keep patterns with long escapes away."""
    out = []
    for atom, quantifier in _atoms(regex):
        if atom.startswith("(?:"):
            atom = "(?:" + _without_anchors(atom[3:-1]) + ")"
        elif atom.startswith("("):
            atom = "(" + _without_anchors(atom[1:-1]) + ")"
        if atom not in ("^", "$"):
            out.append(atom + quantifier)
    return "".join(out)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _literals_of(tokens) -> frozenset[str] | None:
    """Texts of which every match of the parsed pattern holds at least one."""
    found: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    for kind, value in tokens:
        name = str(kind)
        if name == "LITERAL" and 32 <= value < 127:
            run += chr(value).lower()
            continue
        close()
        inner = None
        if name == "SUBPATTERN":
            inner = _literals_of(value[3])
        elif name == "ATOMIC_GROUP":
            inner = _literals_of(value)
        elif name.endswith("REPEAT") and value[0] > 0:
            inner = _literals_of(value[2])
        elif name == "BRANCH":
            branches = [_literals_of(branch) for branch in value[1]]
            if all(branches):
                inner = frozenset().union(*branches)
        if inner:
            found.append(inner)
    close()
    return max(found, key=lambda texts: min(map(len, texts)), default=None)


def required_literals(regex: str) -> list[str]:
    """Lowercase texts of which every match contains one; empty if none are known."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            texts = _literals_of(_parser.parse(regex.replace("(?<", "(?P<") if _NAMED.search(regex) else regex))
    except (re.error, OverflowError, RecursionError, Warning):
        return []
    return sorted(t for t in texts or () if not any(o != t and o in t for o in texts))


def _holds_literal(lowered: Column, literals: Sequence[str]) -> Column:
    """Whether the lowercased text holds a literal, or a letter that only a caseless
    match equates with one of the literals' letters."""
    looked_for = list(literals)
    if any("s" in t for t in literals):
        looked_for.append("\u017f")
    if any("i" in t for t in literals):
        looked_for += ["\u0131", "i\u0307"]
    return _any([lowered.contains(t) for t in looked_for])


def _with_lowered(text: Column, condition: Callable[[Column], Column]) -> Column:
    """Evaluate a condition with the lowercased text computed once."""
    return F.exists(F.array(F.lower(text)), condition)


def matches_any(text: Column, rules: Sequence[Rule]) -> Column:
    """Whether at least one rule matches.

    A rule is only run on texts that hold a literal it requires: looking for a
    literal is several times cheaper than running the pattern.
    """
    rules = _java_rules(rules)

    def test(lowered: Column) -> Column:
        tests = []
        for rule in rules:
            literals = required_literals(rule.regex)
            matched = text.rlike(java_pattern(existence_pattern(rule.regex)))
            tests.append(_holds_literal(lowered, literals) & matched if literals else matched)
        return _any(tests)
    return _with_lowered(text, test)


def may_match(text: Column, rules: Sequence[Rule]) -> Column:
    """A cheap condition on a whole text, or an untrimmed line, that holds whenever one
    of its lines matches a rule.

    It looks for required literals. A rule without a telling literal is run without
    its anchors, which matches a text wherever the rule matches a line, as long as
    the rule only looks at the characters it consumes; failing that, every text
    passes.
    """
    literals: set[str] = set()
    patterns = []
    for rule in _java_rules(rules):
        required = required_literals(rule.regex)
        if required and min(map(len, required)) >= TELLING:
            literals.update(required)
        elif _NOT_LOCAL.search(rule.regex) or _LONG_ESCAPE.search(rule.regex):
            return F.lit(True)
        else:
            patterns.append((required, java_pattern(existence_pattern(_without_anchors(rule.regex)))))

    def test(lowered: Column) -> Column:
        tests = [_holds_literal(lowered, sorted(literals))] if literals else []
        for required, pattern in patterns:
            matched = text.rlike(pattern)
            tests.append(_holds_literal(lowered, required) & matched if required else matched)
        return _any(tests)
    return _with_lowered(text, test)


def _match_end(text: Column, rule: Rule) -> Column:
    """End of the last of the left-to-right matches, in characters."""
    rest = F.element_at(F.split(text, java_pattern(rule.regex), -1), -1)
    return F.length(text) - F.length(rest)


def _matched_rules(text: Column, rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[
        F.when(text.rlike(java_pattern(existence_pattern(rule.regex))), F.lit(rule.id)) for rule in rules]))


def _ends(text: Column, matched: Column, rules: Sequence[Rule]) -> Column:
    """(match_end, rule_id) of the rules found to match."""
    return F.array_compact(F.array(*[
        F.when(F.array_contains(matched, rule.id),
               F.struct(_match_end(text, rule).alias("match_end"), F.lit(rule.id).alias("rule_id")))
        for rule in rules]))


def match_lines(lines: DataFrame, rules: Sequence[Rule], text: str = "match_text",
                every_rule: bool = False) -> DataFrame:
    """Lines x rules on a regex match, adding ``rule_id``.

    By default a line yields one row, for the rule whose last match ends last; on a
    tie the highest rule id wins. Match ends are only looked for where several rules
    match. ``every_rule`` keeps one row per matching rule and adds ``match_end``. The
    choice is made inside the row, so no shuffle is involved.
    """
    line = F.col(text)
    rules = _java_rules(rules)
    hits = lines.filter(matches_any(line, rules)).withColumn("_matched", _matched_rules(line, rules))
    ends = _ends(line, F.col("_matched"), rules)
    # The outer forms keep the optimizer from evaluating the arrays a second time in
    # an inferred filter.
    if every_rule:
        rows = hits.select(*lines.columns, F.inline_outer(ends))
    else:
        last = F.array(F.array_max(ends)["rule_id"])
        chosen = F.when(F.size("_matched") > 1, last).otherwise(F.col("_matched"))
        rows = hits.select(*lines.columns, F.explode_outer(chosen).alias("rule_id"))
    return rows.filter(F.col("rule_id").isNotNull())
