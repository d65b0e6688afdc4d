"""The rule catalogue: where rules come from and how they are kept unique."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve import schemas



class NoRulesError(ValueError):
    """A scan was asked for with an empty catalogue."""


class Rule(NamedTuple):
    id: int
    regex: str
    category: str
    description: str = ""


# The stock catalogue (patterns, categories, descriptions).
DEFAULT_RULES = [
    Rule(1, r"-----BEGIN [A-Z]+ PRIVATE KEY( BLOCK)?-----", "crypto_key", "private key"),
    Rule(2, r"EAACEdEose0cBA[0-9A-Za-z]+", "token", "fb access token"),
    Rule(3, r"[0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com", "token", "google token"),
    Rule(4, r"AKIA[0-9A-Z]{16}", "token", "amazon token"),
    Rule(5, r"[0-9a-fA-F]{7}\.[0-9a-fA-F]{32}", "token", "instagram token"),
    Rule(6, r"^(sha)?[1-9][0-9]+-[0-9a-zA-Z]{40}", "token", "twitter access token"),
    Rule(7, r"key-[0-9a-zA-Z]{32}", "token", "Mailgun API key"),
    Rule(8, r"[0-9a-f]{32}-us[0-9]{1,2}", "token", "MailChimp API key"),
    Rule(9, r"sshpass|password|pwd|passwd|pass[\W_]", "password", "password keywords"),
]


def parse_rules(entries: Iterable[dict], first_id: int = 1) -> list[Rule]:
    """Number rule entries in file order, keeping the first of equal patterns.

    ``regex`` and ``category`` are required and a missing one raises KeyError.
    """
    rules: dict[str, Rule] = {}
    for entry in entries:
        regex, category = entry["regex"], entry["category"]
        if regex not in rules:
            rules[regex] = Rule(first_id + len(rules), regex, category, entry.get("description", ""))
    return list(rules.values())


def read_rules_file(path: str, first_id: int = 1) -> list[Rule]:
    """Rules from a JSON or YAML file with a top-level ``rules`` list."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        content = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML rules needs the yaml package") from error
        content = yaml.safe_load(text)
    return parse_rules(content["rules"], first_id)


def write_rules_file(rules: Iterable[Rule], path: str) -> None:
    """A rules file without ids, as JSON, which is also YAML. It is complete before it takes the place of an older one."""
    entries = [{"regex": r.regex, "category": r.category, "description": r.description} for r in rules]
    with open(f"{path}.new", "w", encoding="utf-8") as handle:
        json.dump({"rules": entries}, handle, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(rule) for rule in rules], schemas.RULES)


def unique_rules(submissions: DataFrame, position: str = "id") -> DataFrame:
    """Keep the first submission of every pattern.

    A grouped minimum instead of a window: equal patterns meet in a partial
    aggregate, so a pattern submitted by a third of all rows is still one small row
    per task when it is shuffled.
    """
    rest = [c for c in submissions.columns if c not in (position, "regex")]
    first = F.min(F.struct(position, *rest)).alias("first")
    return (
        submissions.groupBy("regex").agg(first)
        .select(*[F.col("regex") if c == "regex" else F.col(f"first.{c}").alias(c)
                  for c in submissions.columns])
    )


def add_rules(catalogue: DataFrame, submissions: DataFrame) -> DataFrame:
    """Existing rules plus the submitted ones whose pattern is not known yet."""
    fresh = unique_rules(submissions).join(catalogue.select("regex"), "regex", "left_anti")
    return catalogue.unionByName(fresh.select(*catalogue.columns))


def rules_by_category(rules: DataFrame, category: str | None = None) -> DataFrame:
    return rules if category is None else rules.filter(F.col("category") == category)


def rule_by_id(rules: DataFrame, rule_id: int | Column) -> DataFrame:
    return rules.filter(F.col("id") == rule_id)


def rule_categories(rules: DataFrame) -> DataFrame:
    return rules.select("category").distinct()


def export_rules(rules: DataFrame) -> DataFrame:
    """What a rules file holds: no id."""
    return rules.select("regex", "category", "description")


def scan_rules(rules: DataFrame | Iterable[Rule], category: str | None = None) -> list[Rule]:
    """The rules a scan is planned with, however many; empty is an error. Users write the catalogue, so it is a list of
    patterns, not data that grows with the corpus."""
    if isinstance(rules, DataFrame):
        rows = (rules_by_category(rules, category).select("id", "regex", "category", "description")
                .orderBy("id").collect())
        chosen = [Rule(*row) for row in rows]
    else:
        chosen = [rule for rule in rules if category is None or rule.category == category]
    if not chosen:
        raise NoRulesError("the catalogue has no rule for this scan")
    return chosen
