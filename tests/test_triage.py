"""Models, state changes, similarity, reports and stores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.operators import models, reports, similarity, tables, triage
from keysieve.schemas import DISCOVERIES, STATES
from keysieve.sources.rules import DEFAULT_RULES, Rule, rules_frame

URL = "https://h/o/r"


def discoveries(spark, rows):
    """Rows of (id, state[, file_name[, snippet[, rule_id[, repo_url]]]])."""
    full = []
    for row in rows:
        i, state, *more = row
        file_name, snippet, rule_id, url = [*more, *["f", "s", 1, URL][len(more):]]
        full.append((i, file_name, "c", 1, snippet, url, rule_id, state, None))
    return spark.createDataFrame(full, DISCOVERIES)


@pytest.fixture
def triaged(spark):
    counts = {"new": 5, "false_positive": 6, "addressing": 7, "not_relevant": 8, "fixed": 9}
    states = [s for s, n in counts.items() for _ in range(n)]
    return discoveries(spark, [(i, s, "danger" if s == "new" else "fake_file") for i, s in enumerate(states)])


def test_counts(spark, triaged):
    row = reports.repo_state_counts(triaged).first()
    assert [row[c] for c in ("total", "true_positive", "false_positive", "addressing", "not_relevant", "fixed")] == [35, 5, 6, 7, 8, 9]
    files = {r.file_name: r.tot_discoveries for r in reports.file_summary(triaged, URL).collect()}
    assert files == {"danger": 5, "fake_file": 30}
    assert reports.left_for_review(triaged).first()[0] == 29
    assert reports.preview(triaged).count() == 30 and reports.gate_count(triaged).first()[0] == 35
    assert reports.count_discoveries(triaged, state="fixed", where="S").first()[0] == 0


def test_csv_has_nine_or_twelve_columns(spark, triaged, tmp_path):
    odd = triaged.withColumn("snippet", F.lit('a "quoted", text\nnext')).withColumn("timestamp", F.current_timestamp())
    tables.export_csv(odd, str(tmp_path / "a"))
    back = tables.read_csv(spark, str(tmp_path / "a"), DISCOVERIES)
    assert len(back.columns) == 9 and back.count() == 35
    assert {r.snippet for r in back.collect()} == {'a "quoted", text\nnext'}
    with_rules = reports.with_rules(odd, rules_frame(spark, DEFAULT_RULES))
    assert len(with_rules.columns) == 12 and with_rules.filter("rule_regex is null").isEmpty()


def test_nested_parts_and_preview(spark):
    found = discoveries(spark, [(i, "new", "f", "hot") for i in range(95)] + [(100, "fixed", "f", "one", None)])
    categorised = reports.with_category(found, rules_frame(spark, DEFAULT_RULES))
    nested = reports.nested_occurrences(categorised, part_rows=20).collect()
    assert sorted(o.id for r in nested for o in r.occurrences if r.snippet == "hot") == list(range(95))
    assert len(nested) == 6 and max(len(r.occurrences) for r in nested) < 60
    shown = {r.snippet: r for r in reports.occurrence_preview(categorised).collect()}
    assert [o.id for o in shown["hot"].occurrences] == list(range(10)) and shown["hot"].more == 85
    assert shown["one"].category == "(rule deleted)" and shown["one"].more == 0
    assert sorted(i for r in reports.ids_by_repo(found, 10).collect() for i in r.ids) == [*range(95), 100]
    plan = reports.occurrence_preview(categorised)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_page(spark):
    found = discoveries(spark, [(i, "new" if i % 2 else "fixed", "f", f"s{i % 7}", 1 + i % 3) for i in range(60)])
    groups = {(r.snippet, r.state, r.rule_id) for r in found.collect()}
    page = reports.page_groups(found, 5, 3, "state", True).collect()
    expected = sorted(sorted(groups, key=lambda g: (g[0], g[2])), key=lambda g: g[1], reverse=True)[3:8]
    assert [(r.snippet, r.state, r.rule_id) for r in page] == expected
    assert {r.total for r in page} == {len(groups)}
    pairs = {(s, st) for s, st, _ in expected}
    inside = reports.page_occurrences(found, reports.page_groups(found, 5, 3, "state", True))
    assert sorted(r.id for r in inside.collect()) == sorted(r.id for r in found.collect() if (r.snippet, r.state) in pairs)
    with pytest.raises(ValueError):
        reports.page_groups(found, order_by="id")
    with pytest.raises(ValueError):
        reports.page_groups(found, 0)
    assert reports.page_groups(found, 5000).count() == len(groups)


def test_report_text(spark):
    found = discoveries(spark, [(2, "new", "f", "b"), (1, "new", "g", "a")])
    texts = {r.file_name: r.report for r in reports.report_text(found).collect()}
    assert texts["g"] == "file: g\nsecret: a\nline number: 1\n" + "-" * 40


def test_model_chain(spark):
    models.register_model("below five", models.column_model(lambda s: s.cast("int") < 5))
    models.register_model("below six", models.column_model(lambda s: s.cast("int") < 6))
    found = discoveries(spark, [(i, "new", "f", str(i)) for i in range(10)] + [(20, "fixed", "f", "0")])
    once = models.run_models(found, ["below five", "missing"], DEFAULT_RULES)
    assert sorted(r.id for r in once.collect() if r.state == "false_positive") == [0, 1, 2, 3, 4]
    twice = models.run_models(found, ["below five", "below six"], DEFAULT_RULES).collect()
    assert {r.id: r.flagged_by for r in twice if r.flagged_by} == {**{i: "below five" for i in range(5)}, 5: "below six"}
    assert {r.id: r.state for r in twice}[20] == "fixed"
    assert models.run_models(found.limit(0), ["below five"], DEFAULT_RULES).isEmpty()
    with pytest.raises(ModuleNotFoundError):
        models.get_model("missing")


def test_user_models_see_password_rows_only(spark):
    def load():
        def predict(texts):
            return np.array([0 if t == "harmless" else 1 for t in texts], dtype="int64")
        return predict
    models.register_model("user", models.batch_model(load))
    models.register_model("user once", models.once_per_value(models.batch_model(load)))
    found = discoveries(spark, [(1, "new", "f", "harmless", 9), (2, "new", "f", "harmless", 4), (3, "new", "f", "pw", 9),
                                (4, "addressing", "f", "harmless", 9), (5, "new", "f", "harmless", 9)])
    for name in ("user", "user once"):
        rows = models.run_models(found, [name], DEFAULT_RULES).collect()
        assert sorted(r.id for r in rows if r.state == "false_positive") == [1, 5], name
        assert len(rows) == 5


def test_text_model_learns_from_triage(spark):
    rows = [(i, "false_positive", "f", f"password = os.environ value{i}") for i in range(20)]
    rows += [(100 + i, "addressing", "f", f"password = secret hunter{i}") for i in range(20)]
    pipeline = models.fit_text_model(discoveries(spark, rows))
    models.register_model("password", models.text_model(pipeline))
    fresh = discoveries(spark, [(1, "new", "f", "password = os.environ x", 9), (2, "new", "f", "password = secret y", 9)])
    rows = models.run_models(fresh, ["password"], DEFAULT_RULES).collect()
    assert {r.id: r.state for r in rows} == {1: "false_positive", 2: "new"}
    del models.REGISTRY["password"]


def test_encoders(spark):
    found = discoveries(spark, [(1, "new", "f", "password = 'a'"), (2, "new", "f", 'password = "a"'), (3, "new", "f", ""),
                                (4, "new", "f", "x")])
    rows = {r.id: np.array(r.embedding) for r in models.embed_discoveries(found).collect()}
    assert rows[1].shape == (128,) and np.allclose(rows[1], rows[2]) and np.isclose(np.linalg.norm(rows[1]), 1)

    def load():
        def predict(texts):
            return np.array([[float(len(t)), 1.0] for t in texts])
        return predict
    stored = models.embed_discoveries(found.filter("id < 3"), models.batch_encoder(load))
    complete = models.complete_embeddings(found, stored, models.batch_encoder(load))
    assert {r.id: r.embedding for r in complete.collect()} == {1: [14.0, 1.0], 2: [14.0, 1.0], 3: [0.0, 1.0], 4: [1.0, 1.0]}


def test_similarity_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    vectors = [base + rng.normal(scale=s, size=16) for s in np.linspace(0, 1, 40)] + [np.zeros(16)]
    stored = spark.createDataFrame([(i, f"s{i}", [float(x) for x in v], URL if i % 5 else "other") for i, v in enumerate(vectors)],
                                   "id bigint, snippet string, embedding array<double>, repo_url string")
    target = vectors[3]
    expected = {i for i, v in enumerate(vectors[:-1]) if i % 5 and v @ target / np.linalg.norm(v) / np.linalg.norm(target) > 0.8}
    assert {r.id for r in similarity.similar_to_target(stored, "s3", URL, 0.8).collect()} == expected
    requests = spark.createDataFrame([(1, URL, "s3"), (2, URL, "no such"), (3, "other", "s40")], "request_id int, repo_url string, snippet string")
    got = similarity.similar_to_requests(stored, requests, 0.8).collect()
    assert {(r.request_id, r.id) for r in got} == {(1, i) for i in expected}
    found = discoveries(spark, [(i, "fixed" if i == 4 else "new", "f", f"s{i}", 1, URL if i % 5 else "other") for i in range(41)])
    changed = triage.update_similar(found, stored, "s3", "fixed", URL, threshold=0.8).collect()
    assert {r.id for r in changed if r.state == "fixed"} == expected | {4}
    assert triage.similar_discoveries(found, stored, "s3", "fixed", URL, threshold=0.8).count() == len(expected - {4})
    assert triage.similar_discoveries(found, stored, "unknown", "fixed", URL).isEmpty()
    batch = triage.update_similar_batch(found, stored, requests.withColumn("state", F.lit("not_relevant")), 0.8).collect()
    assert {r.id for r in batch if r.state == "not_relevant"} == expected and len(batch) == 41


def test_state_changes(spark, triaged):
    with pytest.raises(ValueError):
        triage.update_discovery(triaged, 1, "unheard of")
    states = lambda frame: {r.id: r.state for r in frame.collect()}
    before = states(triaged)
    assert states(triage.update_discovery(triaged, 3, "fixed")) == {**before, 3: "fixed"}
    ids = list(range(0, 35, 2))
    wanted = {**before, **{i: "new" for i in ids}}
    assert states(triage.update_discoveries(triaged, ids, "new")) == wanted
    assert states(triage.update_discoveries(triaged, spark.createDataFrame([(i,) for i in ids * 2], "id bigint"), "new")) == wanted
    assert states(triage.update_discovery_group(triaged, "new", URL, "fake_file")) == {i: "new" for i in before}
    assert states(triage.update_discovery_group(triaged, "new", "elsewhere")) == before
    gone = rules_frame(spark, [Rule(2, "x", "other")])
    assert triage.null_missing_rules(triaged, gone).filter("rule_id is not null").isEmpty()
    repos = spark.createDataFrame([("a", 5), ("b", None)], "url string, last_scan bigint")
    news = spark.createDataFrame([("b", 7), ("b", 9), ("c", 1)], "url string, last_scan bigint")
    assert {r.url: r.last_scan for r in triage.upsert_repos(repos, news).collect()} == {"a": 5, "b": 9, "c": 1}
    assert set(STATES) == set(before.values())


def test_store(spark, triaged, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read(spark, path) is None
    tables.append_new(triaged, path)
    tables.append_new(triaged, path)
    assert tables.read(spark, path).count() == 35 and tables.read(spark, path, URL).count() == 35
    assert tables.read(spark, path, "x").count() == 0
    tables.replace(triage.update_discovery_group(tables.read(spark, path), "new", URL), path)
    assert {r.state for r in tables.read(spark, path).collect()} == {"new"}
    tables.append(triaged.withColumn("repo_url", F.lit("other")).withColumn("id", F.col("id") + 100), path)
    tables.rewrite_bucket(spark, path, tables.bucket_of(spark, URL), lambda rows: triage.delete_discoveries(rows, URL))
    assert {r.repo_url for r in tables.read(spark, path).collect()} == {"other"}
