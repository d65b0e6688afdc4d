"""The registered queries: every operator over the derived corpus tables.

``@query`` registers the Spark form under the function's name; ``needs`` and ``sql``
give the same result as SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve import schemas
from keysieve.functions import labels, paths, text, vectors
from keysieve.operators import lines as L
from keysieve.operators import bayes, contents, matching, models, reports, rule_index, search, similarity, tables, triage, vector_index
from keysieve.operators.skew import spread
from keysieve.plans import corpus, oracles, scans
from keysieve.plans.corpus import CORPUS_RULES, EPOCH, HOST
from keysieve.session import shared_dir
from keysieve.sources import commits as C
from keysieve.sources import files as S
from keysieve.sources import patches as P
from keysieve.sources import repos as R
from keysieve.sources import rules as rule_source
from keysieve.sources import snapshots
from keysieve.streaming import jobs as streams
from keysieve.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REPO = HOST + "src6"
ORG = "src1"
DISCOVERY = "id, file_name, commit_id, line_number, snippet, repo_url, rule_id, state, ts"


def query(needs: str = "", sql: str | None = None, extra: dict | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = oracles.expand(needs, sql, extra)
        return build
    return register


def rules_table(spark: SparkSession) -> DataFrame:
    return rule_source.rules_frame(spark, CORPUS_RULES)


def shown(discoveries: DataFrame, *more: str) -> DataFrame:
    """Discoveries with their time as epoch seconds in ``ts``."""
    return discoveries.withColumn("ts", F.unix_timestamp("timestamp")).select(*DISCOVERY.split(", "), *more)


def rounded(column: str, places: int = 6) -> Column:
    return F.round(column, places).alias(column)


# ---- rule catalogue -------------------------------------------------------------

def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_source.unique_rules(corpus.rule_submissions(spark, sf_dir))


@query("catalogue", "SELECT * FROM catalogue")
def rules_catalogue(spark, sf_dir):
    return _catalogue(spark, sf_dir)


@query("catalogue", "SELECT * FROM catalogue WHERE category = 'token'")
def rules_by_category(spark, sf_dir):
    return rule_source.rules_by_category(_catalogue(spark, sf_dir), "token")


@query("catalogue", "SELECT * FROM catalogue WHERE id = 7")
def rule_by_id(spark, sf_dir):
    return rule_source.rule_by_id(_catalogue(spark, sf_dir), 7)


@query("catalogue", "SELECT DISTINCT category FROM catalogue")
def rule_categories(spark, sf_dir):
    return rule_source.rule_categories(_catalogue(spark, sf_dir))


@query("catalogue", "SELECT regex, category, description FROM catalogue")
def export_rules(spark, sf_dir):
    return rule_source.export_rules(_catalogue(spark, sf_dir))


# ---- lines and matches ----------------------------------------------------------

_LINE = ["doc_id", "repo_url", "commit_id", "file_name", "line_number"]


@query("lines", "SELECT doc_id, repo_url, commit_id, file_name, line_number, match_text, snippet FROM lines")
def corpus_lines(spark, sf_dir):
    return L.file_lines(corpus.files(spark, sf_dir)).select(*_LINE, "match_text", "snippet")


_BLANKS = {
    "blank_raw": ("files", """
        SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1)::INTEGER AS line_number, len(p) AS n
        FROM (SELECT doc_id, string_split(content, chr(10)) AS p FROM files)"""),
    "blank_lines": ("blank_raw", f"""
        SELECT doc_id, line_number, {oracles._strip('line')} AS snippet,
               length(CASE WHEN line_number > 1 THEN chr(9) ELSE '' END || line) +
               CASE WHEN line_number < n THEN 3 ELSE 0 END AS width
        FROM blank_raw WHERE n > 1 OR line <> ''"""),
}


@query("blank_lines", "SELECT doc_id, line_number, snippet, width::INTEGER AS width FROM blank_lines", _BLANKS)
def file_snippets(spark, sf_dir):
    """Indented lines with trailing blanks and CR LF ends: blanks count for the rules
    (``width``, newline included) and are gone from the snippet."""
    spaced = F.replace("content", F.lit("\n"), F.lit("  \r\n\t"))
    lines = L.file_lines(corpus.files(spark, sf_dir).withColumn("content", spaced))
    return lines.select("doc_id", "line_number", "snippet", F.length("match_text").alias("width"))


@query("line_matches", """
    SELECT doc_id, repo_url, commit_id, file_name, line_number, snippet, rule_id, match_end::INTEGER AS match_end
    FROM line_matches""")
def scan_matches(spark, sf_dir):
    lines = L.file_lines(corpus.files(spark, sf_dir), rules=CORPUS_RULES)
    return (matching.match_lines(lines, CORPUS_RULES, every_rule=True)
            .select(*_LINE, "snippet", "rule_id", "match_end"))


@query("found", f"SELECT {DISCOVERY} FROM found")
def scan_one_per_line(spark, sf_dir):
    return shown(corpus.new_discoveries(spark, sf_dir))


@query("found", f"""
    SELECT f.* REPLACE (f.repo_url || k.fork AS repo_url)
    FROM (SELECT doc_id, {DISCOVERY} FROM found) f, (VALUES ('', 0), ('-fork', 0), ('-fork-fork', 1)) AS k(fork, least)
    WHERE f.doc_id % 3 >= k.least""")
def scan_by_content(spark, sf_dir):
    """Files of repositories and their forks, each content split and matched once."""
    held = corpus.forked_files(spark, sf_dir)
    store = contents.ContentStore(spark, shared_dir(spark, "contents"))
    store.add(held)
    found = scans.to_discoveries(store.scan(held, CORPUS_RULES), **corpus.shape())
    return shown(found, corpus.document_number().alias("doc_id"))


_MANY = {
    "picked": ("", """
        SELECT row_number() OVER (ORDER BY md5(w), w)::INTEGER AS k, w
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS w FROM documents) QUALIFY k <= 5000"""),
    "rule_words": ("picked", """
        SELECT a.k AS rule_id, a.w FROM picked a
        UNION ALL SELECT a.k, b.w FROM picked a JOIN picked b ON b.k = a.k + 1 WHERE a.k % 3 = 1"""),
    "tokens": ("lines", r"""
        SELECT DISTINCT doc_id, line_number, unnest(regexp_split_to_array(lower(match_text), '[^\pL\pM\pN_]+')) AS w FROM lines"""),
}


def many_rules(spark: SparkSession, sf_dir: str, count: int = 5000) -> list[rule_source.Rule]:
    """A catalogue made from words of the documents; every third rule is for two of them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), 0)
    rows = (corpus.table(spark, sf_dir, "documents").select(F.explode(words).alias("w")).distinct()
            .orderBy(F.md5("w"), "w").limit(count).collect())
    texts = [row.w for row in rows]
    both = [f"(?:{w}|{v})" if k % 3 == 1 and v else w for k, (w, v) in enumerate(zip(texts, [*texts[1:], ""]), 1)]
    return [rule_source.Rule(k, rf"\b{w}\b", "other", "") for k, w in enumerate(both, 1)]


@query("tokens,rule_words", "SELECT DISTINCT doc_id, line_number, rule_id FROM tokens JOIN rule_words USING (w)", _MANY)
def scan_many_rules(spark, sf_dir):
    """All lines against a catalogue of 5000 rules (the catalogue is what is bounded, not the lines)."""
    lines = L.file_lines(corpus.files(spark, sf_dir)).select("doc_id", "line_number", "match_text")
    return rule_index.match_many(lines, many_rules(spark, sf_dir)).select("doc_id", "line_number", "rule_id")


def _side_files(frame: DataFrame, host: str, key: Column, content: str) -> DataFrame:
    number = key.cast("string")
    return frame.select(key.alias("doc_id"), F.lit(host).alias("repo_url"), F.md5(number).alias("commit_id"),
                        F.concat(F.lit("page_"), number, F.lit(".html")).alias("file_name"),
                        F.col(content).alias("content"))


def _page_lines(keep: str) -> dict:
    return {
        "pages_raw": ("", """
            SELECT page_id AS doc_id, unnest(p) AS line, generate_subscripts(p, 1)::INTEGER AS line_number, len(p) AS n
            FROM (SELECT page_id, string_split(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
                                               chr(10)) AS p FROM pages)"""),
        "page_lines": ("pages_raw", f"""
            SELECT doc_id, line_number, line || CASE WHEN line_number < n THEN chr(10) ELSE '' END AS match_text
            FROM pages_raw WHERE (line_number < n OR line <> '') AND {keep}"""),
        "page_matches": ("page_lines", oracles._matches("page_lines", "doc_id, line_number")),
    }


@query("page_matches", "SELECT doc_id, line_number, rule_id FROM page_matches", _page_lines("true"))
def page_matches(spark, sf_dir):
    """Raw web pages in file mode: lines of any length are scanned."""
    pages = _side_files(spread(corpus.table(spark, sf_dir, "pages").select("page_id", "html")), HOST + "pages", F.col("page_id"), "html")
    found = matching.match_lines(L.file_lines(pages, rules=CORPUS_RULES), CORPUS_RULES, every_rule=True)
    return found.select("doc_id", "line_number", "rule_id")


@query("page_matches", "SELECT doc_id, line_number, rule_id FROM page_matches", _page_lines("length(line) < 500"))
def page_patch_matches(spark, sf_dir):
    """The same pages added by a patch: rows over 500 characters are not scanned."""
    pages = _side_files(spread(corpus.table(spark, sf_dir, "pages").select("page_id", "html")), HOST + "pages", F.col("page_id"), "html")
    unified = F.replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    rows = F.transform(F.split(unified, "\n", -1), lambda line, i: F.concat(
        F.lit("@@ -0,0 +"), (i + 1).cast("string"), F.lit(" @@\n+"), line))
    patches = pages.select("doc_id", F.array_join(rows, "\n").alias("patch"))
    found = matching.match_lines(L.patch_lines(patches, rules=CORPUS_RULES), CORPUS_RULES, every_rule=True)
    return found.select("doc_id", "line_number", "rule_id")


@query("turn_matches", "SELECT conv_id, turn, rule_id FROM turn_matches", {
    "turns": ("", "SELECT conv_id, turn, text AS match_text FROM conversations"),
    "turn_matches": ("turns", oracles._matches("turns", "conv_id, turn"))})
def conversation_matches(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("match_text"))
    return matching.match_lines(turns, CORPUS_RULES, every_rule=True).select("conv_id", "turn", "rule_id")


# ---- sources --------------------------------------------------------------------

_TREE = {"tree_found": ("found", """
    SELECT CASE doc_id % 4 WHEN 0 THEN '.config/' WHEN 1 THEN '_x/' ELSE '' END || file_name AS file_name,
           line_number, rule_id, snippet FROM found""")}


@query("tree_found", """
    SELECT file_name, line_number, rule_id, snippet FROM tree_found WHERE NOT starts_with(file_name, 'tests/')""", _TREE)
def file_tree_lines(spark, sf_dir):
    """Land every document as a file, some below dot and underscore folders, and scan the tree with one folder ignored.
    Pieces are so small that longer files are read in dozens of them."""
    root = shared_dir(spark, "tree")
    folder = F.when(F.col("doc_id") % 4 == 0, ".config/").when(F.col("doc_id") % 4 == 1, "_x/").otherwise("")
    files = corpus.files(spark, sf_dir).select(F.concat(folder, "file_name").alias("file_name"), "content")
    corpus.write_tree(files, root)
    found = scans.scan_path(spark, root, CORPUS_RULES, ignore_list=["tests"], piece_bytes=1000)
    return found.select("file_name", "line_number", "rule_id", "snippet")


@query("files", """
    SELECT file_name, file_name LIKE '%.md' OR file_name LIKE 'web/%' AS ignored,
           len(string_split(file_name, '/')) - 1 <= 1 AS shallow,
           NOT (file_name LIKE '%.md' OR file_name LIKE 'web/%') AND len(string_split(file_name, '/')) - 1 <= 1 AS kept
    FROM files""")
def prune_paths(spark, sf_dir):
    keys = corpus.file_keys(spark, sf_dir)
    name = F.col("file_name")
    return keys.select(
        name, (~paths.keep_path(name, ignore_list=["*.md", "web"])).alias("ignored"),
        paths.keep_path(name, max_depth=1).alias("shallow"),
        paths.keep_path(name, max_depth=1, ignore_list=["*.md", "web"]).alias("kept"))


def _branch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository asks for branch dev or, if never scanned, for a commit id."""
    return corpus.repos(spark, sf_dir).select(
        F.col("url").alias("repo_url"), F.when(F.col("last_scan").isNotNull(), "dev").otherwise(F.md5("url")).alias("name"))


_REQUESTS = {
    "requests": ("repos", "SELECT url AS repo_url, CASE WHEN last_scan IS NOT NULL THEN 'dev' ELSE md5(url) END AS name "
                          "FROM repos"),
    "resolved": ("requests,refs", """
        SELECT q.repo_url, q.name, coalesce(r.commit_id, q.name) AS commit_id
        FROM requests q LEFT JOIN refs r ON q.repo_url = r.repo_url AND r.ref_name = 'refs/heads/' || q.name"""),
}


@query("resolved", "SELECT repo_url, name, commit_id FROM resolved", _REQUESTS)
def resolve_ref(spark, sf_dir):
    return C.resolve_refs(_branch_requests(spark, sf_dir), corpus.refs(spark, sf_dir))


@query("resolved,files", """
    SELECT s.repo_url, s.name, s.commit_id, f.committed_date
    FROM resolved s JOIN files f ON s.repo_url = f.repo_url AND s.commit_id = f.commit_id""", _REQUESTS)
def commit_timestamp(spark, sf_dir):
    return C.commit_timestamps(_branch_requests(spark, sf_dir), corpus.refs(spark, sf_dir),
                               corpus.commits(spark, sf_dir))


@query("resolved,lines", """
    SELECT l.repo_url, l.commit_id, l.file_name, l.line_number, l.snippet
    FROM lines l SEMI JOIN resolved s ON l.repo_url = s.repo_url AND l.commit_id = s.commit_id
    WHERE l.file_name NOT LIKE '%.css'""", _REQUESTS)
def snapshot_lines(spark, sf_dir):
    files = S.snapshot_files(corpus.files(spark, sf_dir), corpus.refs(spark, sf_dir),
                             _branch_requests(spark, sf_dir), ignore_list=["*.css"])
    return L.file_lines(files).select("repo_url", "commit_id", "file_name", "line_number", "snippet")


_PAIR = "repo_url, branch, pos, commit_id, committed_date, parent_id"


@query("pairs", f"SELECT {_PAIR} FROM pairs")
def commit_pairs(spark, sf_dir):
    return C.commit_pairs(corpus.commits(spark, sf_dir))


# Commit dates rise along a branch in the corpus; shuffling them by a modulus makes the
# stop rule differ from a filter.
def _uneven_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.commits(spark, sf_dir).withColumn(
        "committed_date", F.col("committed_date") - (F.col("pos") * 37 % 11) * 3600)


_UNEVEN = {
    "uneven": ("pairs", "SELECT * REPLACE (committed_date - (pos * 37 % 11) * 3600 AS committed_date) FROM pairs"),
    "uneven_kept": ("uneven", f"""
        SELECT * FROM (SELECT *, max((committed_date <= {EPOCH + 600})::INTEGER)
                              OVER (PARTITION BY repo_url, branch ORDER BY pos) AS stopped FROM uneven)
        WHERE stopped = 0"""),
}


@query("uneven_kept", f"SELECT {_PAIR} FROM uneven_kept", _UNEVEN)
def commits_since(spark, sf_dir):
    return C.commits_since(C.commit_pairs(_uneven_commits(spark, sf_dir)), EPOCH + 600).select(*_PAIR.split(", "))


@query("commits", "SELECT * FROM commits WHERE pos < 5")
def commits_max_depth(spark, sf_dir):
    return C.newest_commits(corpus.commits(spark, sf_dir), 5)


_FIRST_BRANCH = {"unique_pairs": ("pairs", """
    SELECT * EXCLUDE (place) FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_url, commit_id, parent_id ORDER BY branch) AS place FROM pairs)
    WHERE place = 1""")}


@query("unique_pairs", f"SELECT {_PAIR} FROM unique_pairs", _FIRST_BRANCH)
def commit_pairs_dedup(spark, sf_dir):
    return C.unique_pairs(C.commit_pairs(corpus.commits(spark, sf_dir)))


@query("unique_pairs,pairs", f"""
    SELECT {_PAIR} FROM unique_pairs u WHERE NOT EXISTS (
        SELECT 1 FROM pairs d WHERE d.branch = 'dev' AND d.repo_url = u.repo_url AND d.commit_id = u.commit_id
                                AND d.parent_id = u.parent_id)""", _FIRST_BRANCH)
def new_pairs_only(spark, sf_dir):
    """Pairs left to scan when branch dev was scanned before."""
    pairs = C.commit_pairs(corpus.commits(spark, sf_dir))
    return C.new_pairs_only(C.unique_pairs(pairs), pairs.filter(F.col("branch") == "dev")).select(*_PAIR.split(", "))


_PATCH = "repo_url, commit_id, parent_id, change_type, file_name, md5(patch) AS patch_digest"


def _digested(patches: DataFrame) -> DataFrame:
    return patches.select("repo_url", "commit_id", "parent_id", "change_type", "file_name",
                          F.md5("patch").alias("patch_digest"))


@query("pair_patches", f"SELECT {_PATCH} FROM pair_patches")
def patch_rows(spark, sf_dir):
    return _digested(P.patch_rows(corpus.patches(spark, sf_dir)))


@query("text_patches", f"SELECT {_PATCH} FROM text_patches WHERE parent_id IS NULL")
def root_patches(spark, sf_dir):
    return _digested(P.root_patches(corpus.patches(spark, sf_dir)))


_PR = {"pr": ("doc_patches", "SELECT * FROM doc_patches WHERE doc_id % 9 <> 0")}


@query("pr", """
    SELECT repo_url, (doc_id % 50)::INTEGER AS pr_number, commit_id, file_name, md5(patch) AS patch_digest FROM pr""", _PR)
def pr_patch_rows(spark, sf_dir):
    documents = corpus.pull_requests(spark, sf_dir).select(F.from_json("value", schemas.PR_COMMITS).alias("d")).select("d.*")
    return P.pull_request_patches(documents).select("repo_url", "pr_number", "commit_id", "file_name",
                                                    F.md5("patch").alias("patch_digest"))


_DELTA = {
    "scanned": ("commits", "SELECT DISTINCT repo_url, commit_id AS commit_from FROM commits WHERE branch = 'main' AND pos = 1"),
    "heads": ("commits", "SELECT repo_url, commit_id FROM commits WHERE branch = 'main' AND pos = 0"),
    "delta": ("heads,scanned", "SELECT h.repo_url, commit_id, commit_from FROM heads h JOIN scanned s ON h.repo_url = s.repo_url"),
    "delta_patches": ("pair_patches,delta", """
        SELECT p.* FROM pair_patches p SEMI JOIN delta d
        ON p.repo_url = d.repo_url AND p.commit_id = d.commit_id AND p.parent_id = d.commit_from"""),
    **oracles.patch_scan("delta", "delta_patches"),
}


def _delta_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Repositories last scanned at the time of their second newest commit."""
    commits = corpus.commits(spark, sf_dir)
    scanned = (commits.filter((F.col("branch") == "main") & (F.col("pos") == 1))
               .select(F.col("repo_url").alias("url"), F.col("committed_date").alias("last_scan")))
    return commits, scanned


@query("delta", "SELECT repo_url, commit_id, commit_from FROM delta", _DELTA)
def snapshot_delta(spark, sf_dir):
    commits, scanned = _delta_inputs(spark, sf_dir)
    heads = commits.filter((F.col("branch") == "main") & (F.col("pos") == 0))
    return C.snapshot_delta(commits, scanned, heads)


_DIFF = {
    "new_pieces": ("files", """
        SELECT doc_id, repo_url, file_name, flatten(list_transform(string_split(content, chr(10)), lambda x, k: CASE
                 WHEN doc_id % 5 = 0 OR NOT ((k - 1) % 9 IN (3, 6) OR (k - 1) % 14 = 2) THEN [{'line': x, 'fresh': doc_id % 11 = 0}]
                 WHEN (k - 1) % 9 = 3 THEN []
                 ELSE (CASE WHEN (k - 1) % 9 = 6 THEN [] ELSE [{'line': x, 'fresh': doc_id % 11 = 0}] END)
                      || [{'line': CASE WHEN k % 2 = 1 THEN 'mail m' || doc_id || '.' || k || '@h.org' ELSE 'line ' || doc_id || '.' || k END,
                           'fresh': true}] END)) AS p
        FROM files WHERE doc_id % 13 <> 0"""),
    "new_lines": ("new_pieces", """
        SELECT doc_id, repo_url, md5(repo_url || 'old') AS commit_from, md5(repo_url || 'new') AS commit_id, file_name,
               k::INTEGER AS line_number, p[k].line AS line
        FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM new_pieces)
        WHERE p[k].fresh AND NOT (k = len(p) AND p[k].line = '')"""),
}


def _snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_diff(corpus.snapshot_files(spark, sf_dir), corpus.snapshot_pairs(spark, sf_dir))


@query("new_lines", "SELECT repo_url, commit_from, commit_id, file_name, line_number, line FROM new_lines", _DIFF)
def snapshot_diff_lines(spark, sf_dir):
    """Two snapshots of every repository, of which no patch is landed: the lines the later one adds."""
    return snapshots.added_lines(_snapshot_diff(spark, sf_dir))


_DIFF |= {
    "new_trimmed": ("new_lines", f"""
        SELECT *, CASE WHEN {oracles._strip('line')} <> '' THEN {oracles._strip('line')} ELSE '+' || line END AS snippet
        FROM new_lines WHERE length(line) < 500"""),
    "new_texts": ("new_trimmed", "SELECT *, snippet AS match_text FROM new_trimmed"),
    "new_matches": ("new_texts", oracles._matches("new_texts", "doc_id, repo_url, commit_id, file_name, line_number, snippet")),
    "new_found": ("new_matches", f"""
        SELECT doc_id * 10000000 + line_number * 100 + rule_id AS id, file_name, commit_id, line_number, snippet, repo_url,
               rule_id, 'new' AS state, {EPOCH} + doc_id * 60 AS ts
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_number ORDER BY match_end DESC, rule_id DESC) AS place
              FROM new_matches) WHERE place = 1"""),
}


@query("new_found", f"SELECT {DISCOVERY} FROM new_found", _DIFF)
def snapshot_diff_scan(spark, sf_dir):
    """The same two snapshots scanned for what changed between them."""
    return shown(scans.scan_snapshot_diff(corpus.snapshot_files(spark, sf_dir), corpus.snapshot_pairs(spark, sf_dir),
                                          CORPUS_RULES, **corpus.shape()))


_STAGED = {
    "staged": ("doc_patches", """
        SELECT * FROM doc_patches WHERE doc_id % 6 NOT IN (1, 2)"""),
    "staged_raw": ("staged", f"""
        SELECT repo_url, commit_id, file_name, doc_id, unnest(r) AS row, generate_subscripts(r, 1) AS k
        FROM (SELECT *, string_split_regex(patch, {oracles._PATCH_BREAK}) AS r FROM staged)"""),
    "staged_lines": ("staged_raw", """
        SELECT repo_url, commit_id, file_name, doc_id, substr(row, 2) AS line,
               (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INTEGER AS line_number
        FROM staged_raw WHERE starts_with(row, '+') AND NOT starts_with(row, '+++')"""),
    "staged_text": ("staged_lines", f"SELECT *, line || chr(10) AS match_text, {oracles._strip('line')} AS snippet FROM staged_lines"),
    "staged_matches": ("staged_text", oracles._matches(
        "staged_text", "doc_id, repo_url, commit_id, file_name, line_number, snippet")),
    "staged_found": ("staged_matches", """
        SELECT doc_id * 10000000 + line_number * 100 + rule_id AS id, * FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, line_number ORDER BY match_end DESC, rule_id DESC) AS place
            FROM staged_matches) WHERE place = 1"""),
}


def _staged_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    patches = corpus.document_patches(spark, sf_dir)
    key = ["repo_url", "commit_id", "file_name"]
    status = corpus.by_remainder(F.col("doc_id"), ("A", "D", "R100", "M", "A", "M"))
    return (corpus.file_keys(spark, sf_dir).select(*key, status.alias("status")),
            patches.select(*key, F.col("patch").alias("diff")))


@query("staged_lines", "SELECT repo_url, commit_id, file_name, line_number, line FROM staged_lines", _STAGED)
def added_lines(spark, sf_dir):
    name_status, diffs = _staged_inputs(spark, sf_dir)
    key = ["repo_url", "commit_id", "file_name"]
    return P.added_lines(diffs.join(P.staged_files(name_status).select(*key), key, "left_semi"))


@query("staged_found", f"""
    SELECT id, file_name, line_number, snippet, rule_id FROM staged_found
    WHERE rule_id <> 5 OR NOT regexp_matches(lower(file_name), {oracles._text(paths.FALSE_POSITIVE_PATH)})""", _STAGED)
def staged_gate(spark, sf_dir):
    name_status, diffs = _staged_inputs(spark, sf_dir)
    found = scans.scan_staged(name_status, diffs, CORPUS_RULES, models=["path"], **corpus.shape())
    return found.select("id", "file_name", "line_number", "snippet", "rule_id")


def _repos_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose number starts with 1 belong to one organisation; some are forks."""
    repos = corpus.repos(spark, sf_dir)
    return repos.select("url", F.regexp_extract("url", r"(src\d)", 1).alias("owner"),
                        F.coalesce(F.col("last_scan") % 3 == 0, F.lit(False)).alias("fork"))


_ORG = {
    "org": ("repos", f"""
        SELECT url FROM repos WHERE regexp_extract(url, '(src[0-9])', 1) = '{ORG}'
                                AND NOT coalesce(last_scan % 3 = 0, false)"""),
    "org_patches": ("text_patches,org", """
        SELECT * FROM text_patches p SEMI JOIN org o ON p.repo_url = o.url
        WHERE p.parent_id IS NULL OR p.change_type IN ('A', 'M')"""),
    **oracles.patch_scan("org", "org_patches"),
}


@query("org_found", f"SELECT {DISCOVERY} FROM org_found", _ORG)
def multi_repo_scan(spark, sf_dir):
    return shown(scans.scan_user(corpus.patches(spark, sf_dir), corpus.commits(spark, sf_dir),
                                 _repos_meta(spark, sf_dir), ORG, CORPUS_RULES, **corpus.shape()))


@query("repos", "SELECT url, url || '.wiki.git' AS wiki FROM repos")
def wiki_urls(spark, sf_dir):
    repos = corpus.repos(spark, sf_dir).select("url", F.col("url").alias("wiki"))
    return R.wiki_repos(R.wiki_repos(repos, "wiki"), "wiki")


# ---- scan jobs ------------------------------------------------------------------

_HISTORY = {
    "history_patches": ("text_patches", """
        SELECT * FROM text_patches WHERE parent_id IS NULL OR change_type IN ('A', 'M')"""),
    **oracles.patch_scan("history", "history_patches"),
    "late_pairs": ("pairs", f"""
        SELECT DISTINCT repo_url, commit_id, parent_id FROM (
            SELECT *, max((committed_date <= {EPOCH + 12000})::INTEGER) OVER (
                       PARTITION BY repo_url, branch ORDER BY pos) AS stopped FROM pairs WHERE pos < 29)
        WHERE stopped = 0"""),
    "late_patches": ("pair_patches,late_pairs", """
        SELECT p.* FROM pair_patches p SEMI JOIN late_pairs l
        ON p.repo_url = l.repo_url AND p.commit_id = l.commit_id AND p.parent_id = l.parent_id"""),
    **oracles.patch_scan("late", "late_patches"),
}


@query("history_found", f"SELECT {DISCOVERY} FROM history_found", _HISTORY)
def history_scan(spark, sf_dir):
    return shown(scans.scan_history(corpus.patches(spark, sf_dir), corpus.commits(spark, sf_dir),
                                    CORPUS_RULES, **corpus.shape()))


@query("late_found", f"SELECT {DISCOVERY} FROM late_found", _HISTORY)
def history_scan_since(spark, sf_dir):
    """A repeated scan: commits after a time, at most 30 per branch, no first commits."""
    return shown(scans.scan_history(corpus.patches(spark, sf_dir), corpus.commits(spark, sf_dir), CORPUS_RULES,
                                    since=EPOCH + 12000, max_depth=30, **corpus.shape()))


@query("found,resolved", f"""
    SELECT {DISCOVERY} FROM found f SEMI JOIN resolved s ON f.repo_url = s.repo_url AND f.commit_id = s.commit_id""",
       _REQUESTS)
def snapshot_scan(spark, sf_dir):
    return shown(scans.scan_snapshot(corpus.files(spark, sf_dir), corpus.refs(spark, sf_dir),
                                     _branch_requests(spark, sf_dir), CORPUS_RULES, **corpus.shape()))


@query("delta_found", f"SELECT {DISCOVERY} FROM delta_found", _DELTA)
def snapshot_delta_scan(spark, sf_dir):
    commits, scanned = _delta_inputs(spark, sf_dir)
    requests = scanned.select(F.col("url").alias("repo_url"), F.lit("main").alias("name"))
    return shown(scans.scan_snapshot_delta(corpus.patches(spark, sf_dir), commits, scanned,
                                           corpus.refs(spark, sf_dir), requests, CORPUS_RULES, **corpus.shape()))


@query("pr_found", f"SELECT {DISCOVERY} FROM pr_found", {
    "pr": ("doc_patches", "SELECT *, NULL AS parent_id FROM doc_patches WHERE doc_id % 9 <> 0"),
    **oracles.patch_scan("pr", "pr")})
def pull_request_scan(spark, sf_dir):
    documents = corpus.pull_requests(spark, sf_dir).select(F.from_json("value", schemas.PR_COMMITS).alias("d")).select("d.*")
    return shown(scans.scan_pull_requests(documents, CORPUS_RULES, **corpus.shape()))


@query("history_found", f"""
    SELECT * REPLACE (repo_url || '.wiki.git' AS repo_url) FROM (SELECT {DISCOVERY} FROM history_found)""", _HISTORY)
def wiki_scan(spark, sf_dir):
    """The commits of the corpus taken as those of wikis."""
    wiki = F.concat("repo_url", F.lit(".wiki.git"))
    return shown(scans.scan_wiki(corpus.patches(spark, sf_dir).withColumn("repo_url", wiki),
                                 corpus.commits(spark, sf_dir).withColumn("repo_url", wiki),
                                 corpus.repos(spark, sf_dir), CORPUS_RULES, **corpus.shape()))


# ---- patch rows -----------------------------------------------------------------

_ROWS = {
    "all_patches": ("doc_patches", "SELECT *, NULL AS parent_id FROM doc_patches"),
    **oracles.patch_scan("all", "all_patches"),
}


@query("all_lines", "SELECT doc_id, line_number, row, snippet FROM all_lines", _ROWS)
def diff_line_numbers(spark, sf_dir):
    return L.patch_lines(corpus.document_patches(spark, sf_dir)).select("doc_id", "line_number", "row", "snippet")


@query("all_kept", "SELECT doc_id, count(*) AS scannable, sum(length(row))::BIGINT AS characters FROM all_kept GROUP BY doc_id", _ROWS)
def diff_scannable_rows(spark, sf_dir):
    rows = F.filter(F.split("patch", text.PATCH_ROW_BREAK, -1),
                    lambda row: text.is_scannable_row(row) & (row != ""))
    exploded = corpus.document_patches(spark, sf_dir).select("doc_id", F.explode_outer(rows).alias("row"))
    return (exploded.filter(F.col("row").isNotNull()).groupBy("doc_id")
            .agg(F.count("*").alias("scannable"), F.sum(F.length("row").cast("bigint")).alias("characters")))


@query("all_kept", f"""
    SELECT doc_id, (k - 1)::INTEGER AS row_number, regexp_extract(row, {oracles._HEADER}, 2)::INTEGER AS first_line
    FROM all_kept WHERE is_header""", _ROWS)
def hunk_headers(spark, sf_dir):
    return L.hunk_headers(corpus.document_patches(spark, sf_dir)).select("doc_id", "row_number", "first_line")


@query("all_lines", "SELECT doc_id, line_number, snippet FROM all_lines WHERE snippet <> row", _ROWS)
def diff_snippets(spark, sf_dir):
    rows = L.patch_lines(corpus.document_patches(spark, sf_dir))
    return rows.filter(F.col("snippet") != F.col("row")).select("doc_id", "line_number", "snippet")


# ---- paths, urls, labels --------------------------------------------------------

@query("files", f"""
    SELECT file_name, regexp_matches(lower(file_name), {oracles._text(paths.FALSE_POSITIVE_PATH)}) AS false_positive
    FROM files""")
def path_model(spark, sf_dir):
    keys = corpus.file_keys(spark, sf_dir)
    return keys.select("file_name", paths.is_false_positive_path(F.col("file_name")).alias("false_positive"))


@query("", r"""
    SELECT page_id, regexp_replace(regexp_replace(u, '/$', ''), '\.git$', '') AS url FROM (
        SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.git' WHEN 1 THEN '/' WHEN 2 THEN '.git/' ELSE '//' END AS u
        FROM pages)""")
def normalise_urls(spark, sf_dir):
    ending = corpus.by_remainder(F.col("page_id"), (".git", "/", ".git/", "//"))
    pages = corpus.table(spark, sf_dir, "pages")
    return pages.select("page_id", paths.normalise_url(F.concat("url", ending)).alias("url"))


@query("", """
    SELECT page_id, starts_with(u, 'http://') OR starts_with(u, 'https://') AS remote
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/data/' || page_id ELSE url END AS u FROM pages)""")
def url_kind(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/data/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return pages.select("page_id", paths.is_remote(url).alias("remote"))


@query("", """
    SELECT page_id, string_split(url, '/')[-2] AS owner, string_split(url, '/')[-1] AS repo FROM pages""")
def owner_repo(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    return pages.select("page_id", paths.owner(F.col("url")).alias("owner"), paths.repo_name(F.col("url")).alias("repo"))


@query("", f"""
    SELECT state, state IN ({", ".join(map(oracles._text, schemas.STATES))}) AS valid, count(*) AS updates
    FROM (SELECT CASE WHEN event_type = 'click' THEN 'fixed' ELSE event_type END AS state FROM events) GROUP BY ALL""")
def valid_states(spark, sf_dir):
    """Event types asked for as states: only known states would be applied."""
    kind = F.when(F.col("event_type") == "click", "fixed").otherwise(F.col("event_type"))
    asked = corpus.table(spark, sf_dir, "events").groupBy(kind.alias("state")).agg(F.count("*").alias("updates"))
    return asked.select("state", triage.valid_state(F.col("state")).alias("valid"), "updates")


@query("repos", """
    SELECT url, CASE WHEN last_scan IS NULL OR last_scan = 0 THEN 'Never'
                     ELSE strftime(make_timestamp(last_scan * 1000000), '%Y/%m/%d %H:%M:%S') END AS last_scan FROM repos""")
def last_scan_label(spark, sf_dir):
    return corpus.repos(spark, sf_dir).select("url", labels.scan_time(F.col("last_scan")).alias("last_scan"))


@query("disc", """
    SELECT id, repo_url || '/blob/' || commit_id || '/' || file_name || '#L' || line_number AS link FROM disc""")
def permalinks(spark, sf_dir):
    link = paths.permalink(F.col("repo_url"), F.col("commit_id"), F.col("file_name"), F.col("line_number"))
    return corpus.discoveries(spark, sf_dir).select("id", link.alias("link"))


@query("disc", """
    SELECT id, CASE state WHEN 'new' THEN 'leak' WHEN 'false_positive' THEN 'false positive'
                          WHEN 'not_relevant' THEN 'not relevant' ELSE state END AS label FROM disc""")
def state_labels(spark, sf_dir):
    return corpus.discoveries(spark, sf_dir).select("id", labels.state_label(F.col("state")).alias("label"))


@query("found", """
    SELECT id, replace(snippet, '''', '"') AS snippet FROM found""")
def normalise_snippets(spark, sf_dir):
    return corpus.new_discoveries(spark, sf_dir).select("id", text.normalise_quotes(F.col("snippet")).alias("snippet"))


@query("found", """
    SELECT repo_url, commit_id, file_name, 0 AS part,
           string_agg('file: ' || file_name || chr(10) || 'secret: ' || snippet || chr(10) || 'line number: ' ||
                      line_number || chr(10) || repeat('-', 40), '' ORDER BY line_number) AS report
    FROM found GROUP BY ALL""")
def report_text(spark, sf_dir):
    return reports.report_text(corpus.new_discoveries(spark, sf_dir))


# ---- stored discoveries ---------------------------------------------------------

@query("disc", f"SELECT {DISCOVERY} FROM disc WHERE repo_url = '{REPO}' AND file_name LIKE '%.py'")
def get_discoveries(spark, sf_dir):
    found = reports.filter_discoveries(corpus.discoveries(spark, sf_dir), repo_url=REPO)
    return shown(found.filter(F.col("file_name").endswith(".py")))


@query("disc", f"""
    SELECT {DISCOVERY} FROM disc WHERE state IN ('new', 'fixed') AND contains(snippet, 'icensed')
                                   AND contains(lower(snippet), 'apache')""")
def filter_discoveries(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    chosen = [reports.filter_discoveries(found, state=state, where="icensed") for state in ("new", "fixed")]
    return shown(reports.filter_discoveries(chosen[0].unionByName(chosen[1]), where="aPaChe", ignore_case=True))


@query("disc,rules", f"""
    SELECT {", ".join("d." + c for c in DISCOVERY.split(", "))}, r.regex AS rule_regex, r.category AS rule_category,
           r.description AS rule_description
    FROM disc d LEFT JOIN rules r ON d.rule_id = r.id""")
def discoveries_with_rules(spark, sf_dir):
    joined = reports.with_rules(corpus.discoveries(spark, sf_dir), rules_table(spark))
    return shown(joined, "rule_regex", "rule_category", "rule_description")


@query("disc,rules", """
    SELECT d.id, coalesce(r.category, '(rule deleted)') AS category
    FROM disc d LEFT JOIN (SELECT * FROM rules WHERE id <> 4) r ON d.rule_id = r.id""")
def category_default(spark, sf_dir):
    kept = rules_table(spark).filter(F.col("id") != 4)
    return reports.with_category(corpus.discoveries(spark, sf_dir), kept).select("id", "category")


@query("disc", """
    SELECT id, CASE WHEN rule_id = 5 THEN 'password' ELSE 'other' END AS kind FROM disc""")
def password_split(spark, sf_dir):
    passwords, others = models.password_split(corpus.stored_discoveries(spark, sf_dir), rules_table(spark))
    return models.rejoin(passwords.select("id", F.lit("password").alias("kind")),
                         others.select("id", F.lit("other").alias("kind")))


# ---- counts and views -----------------------------------------------------------

def _state_counts(names: dict) -> str:
    return ", ".join(f"count(*) FILTER (state = '{state}') AS {name}" for state, name in names.items())


_COUNTS = _state_counts({"new": "true_positive", "false_positive": "false_positive", "addressing": "addressing",
                         "not_relevant": "not_relevant", "fixed": "fixed"})
_FILES = _state_counts({"new": "new", "false_positive": "false_positives", "addressing": "addressing",
                        "not_relevant": "not_relevant"})


@query("disc", f"SELECT repo_url, count(*) AS total, {_COUNTS} FROM disc GROUP BY repo_url")
def repo_state_counts(spark, sf_dir):
    return reports.repo_state_counts(corpus.discoveries(spark, sf_dir))


@query("repos,disc", f"""
    SELECT r.url, r.last_scan, coalesce(c.total, 0) AS total, coalesce(true_positive, 0) AS "TP",
           coalesce(false_positive, 0) AS "FP", coalesce(addressing, 0) AS addressing,
           coalesce(not_relevant, 0) AS not_relevant, coalesce(fixed, 0) AS fixed, r.last_scan IS NULL AS scan_active
    FROM repos r LEFT JOIN (SELECT repo_url, count(*) AS total, {_COUNTS} FROM disc WHERE rule_id <> 2
                            GROUP BY repo_url) c ON r.url = c.repo_url""")
def repo_overview(spark, sf_dir):
    repos = corpus.repos(spark, sf_dir)
    found = corpus.stored_discoveries(spark, sf_dir).filter(F.col("rule_id") != 2)
    return reports.repo_overview(repos, found, repos.filter(F.col("last_scan").isNull()))


@query("disc", f"SELECT repo_url, file_name, count(*) AS tot_discoveries, {_FILES} FROM disc GROUP BY ALL")
def file_summary(spark, sf_dir):
    return reports.file_summary(corpus.discoveries(spark, sf_dir))


@query("disc", f"""
    SELECT repo_url, file_name, count(*) AS tot_discoveries, {_FILES} FROM disc WHERE repo_url = '{REPO}' GROUP BY ALL""")
def top_files(spark, sf_dir):
    return reports.top_files(corpus.discoveries(spark, sf_dir), REPO)


@query("disc", "SELECT file_name, snippet, state, count(*) AS occurrences FROM disc GROUP BY ALL")
def discovery_groups(spark, sf_dir):
    return reports.discovery_groups(corpus.discoveries(spark, sf_dir))


@query("disc", f"""
    SELECT file_name, snippet, state, count(*) AS occurrences FROM disc
    WHERE repo_url = '{REPO}' AND state = 'new' GROUP BY ALL""")
def discovery_groups_by_state(spark, sf_dir):
    return reports.discovery_groups(corpus.discoveries(spark, sf_dir), REPO, "new")


@query("disc", """
    SELECT count(*) AS total FROM disc WHERE state = 'false_positive' AND contains(snippet, 'icense')""")
def count_discoveries(spark, sf_dir):
    return reports.count_discoveries(corpus.discoveries(spark, sf_dir), state="false_positive", where="icense")


@query("disc", "SELECT count(*) FILTER (state <> 'false_positive') AS left_for_review FROM disc")
def left_for_review(spark, sf_dir):
    return reports.left_for_review(corpus.discoveries(spark, sf_dir))


@query("disc", "SELECT count(*) AS exit_status FROM disc")
def scan_gate_count(spark, sf_dir):
    return reports.gate_count(corpus.discoveries(spark, sf_dir))


@query("cat", "SELECT snippet, category, state, file_name, line_number, commit_id, id FROM cat")
def nested_occurrences(spark, sf_dir):
    nested = reports.nested_occurrences(reports.with_category(corpus.stored_discoveries(spark, sf_dir), rules_table(spark)))
    return nested.select("snippet", "category", "state", F.inline("occurrences"))


@query("cat", """
    SELECT snippet, category, state, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (place <= 10) AS shown,
           count(*) AS total, greatest(count(*) - 10, 0) AS more
    FROM (SELECT *, row_number() OVER (PARTITION BY snippet, category, state ORDER BY id) AS place FROM cat) GROUP BY ALL""")
def occurrence_preview(spark, sf_dir):
    previews = reports.occurrence_preview(reports.with_category(corpus.stored_discoveries(spark, sf_dir), rules_table(spark)))
    ids = F.transform("occurrences", lambda o: o["id"].cast("string"))
    return previews.select("snippet", "category", "state", F.array_join(ids, ",").alias("shown"), "total", "more")


@query("repos,disc", """
    SELECT (SELECT count(*) FROM repos) AS repos, count(DISTINCT (repo_url, file_name)) AS unique_files,
           count(*) AS discoveries FROM disc""")
def grand_totals(spark, sf_dir):
    return reports.grand_totals(corpus.repos(spark, sf_dir), corpus.stored_discoveries(spark, sf_dir))


@query("disc", "SELECT repo_url, id FROM disc")
def ids_by_repo(spark, sf_dir):
    return reports.ids_by_repo(corpus.stored_discoveries(spark, sf_dir)).select("repo_url", F.explode("ids").alias("id"))


PATTERNS = ("tion th", "@", "éau", "copyright", " = ", "zq#zq", "er er")


@query("lines", "SELECT p.pattern, doc_id, line_number FROM lines, (VALUES " + ", ".join(f"('{p}')" for p in PATTERNS) + """) AS p(pattern)
    WHERE contains(snippet, p.pattern)""")
def search_snippets(spark, sf_dir):
    """Substrings in the lines of all documents, by an index of trigrams."""
    lines = L.file_lines(corpus.files(spark, sf_dir))
    rows = lines.select((F.col("doc_id") * 10000000 + F.col("line_number")).alias("id"), F.col("snippet").alias("text"))
    index = search.SearchIndex.build(rows, shared_dir(spark, "search"), part_rows=20_000)
    found = [index.search(p).select(F.lit(p).alias("pattern"), F.floor(F.col("id") / 10000000).alias("doc_id"),
                                    (F.col("id") % 10000000).cast("int").alias("line_number")) for p in PATTERNS]
    return reduce(DataFrame.unionByName, found)


_GROUPS = {"groups": ("disc", """
    SELECT snippet, state, rule_id, count(*) AS occurrences, count(*) OVER () AS total
    FROM disc GROUP BY snippet, state, rule_id"""),
    "page": ("groups", "SELECT * FROM groups ORDER BY rule_id DESC, snippet, state LIMIT 20 OFFSET 10"),
    "places": ("page", """
        SELECT snippet, state, min(place) AS place
        FROM (SELECT *, row_number() OVER (ORDER BY rule_id DESC, snippet, state) AS place FROM page) GROUP BY snippet, state"""),
    "located": ("disc,page", """
        SELECT d.* FROM disc d SEMI JOIN page p ON d.snippet = p.snippet AND d.state = p.state""")}


@query("groups", "SELECT snippet, state, rule_id, occurrences, total FROM groups", _GROUPS)
def unique_total(spark, sf_dir):
    return reports.unique_groups(corpus.stored_discoveries(spark, sf_dir))


@query("page", "SELECT snippet, state, rule_id, occurrences, total FROM page", _GROUPS)
def page_groups(spark, sf_dir):
    return reports.page_groups(corpus.stored_discoveries(spark, sf_dir), 20, 10, "category", True)


@query("groups", """
    SELECT row_number() OVER (ORDER BY rule_id DESC, snippet, state) AS place, snippet, state, rule_id, occurrences, total FROM groups""", _GROUPS)
def deep_pages(spark, sf_dir):
    """All groups in their order with their places, as pages read from ranges give them."""
    index = reports.paged_groups(corpus.stored_discoveries(spark, sf_dir), shared_dir(spark, "pages"), "category", True, range_rows=30)
    return index.all_rows()


@query("located", f"SELECT {DISCOVERY} FROM located", _GROUPS)
def page_occurrences(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    return shown(reports.page_occurrences(found, reports.page_groups(found, 20, 10, "category", True)))


@query("located,rules,places", """
    SELECT p.place::INTEGER AS place, d.snippet, r.category, d.state, d.file_name, d.line_number, d.commit_id, d.id
    FROM located d JOIN rules r ON d.rule_id = r.id JOIN places p ON p.snippet = d.snippet AND p.state = d.state""", _GROUPS)
def discoveries_page(spark, sf_dir):
    page = reports.discoveries_page(corpus.stored_discoveries(spark, sf_dir), rules_table(spark), 20, 10, "category", True)
    return page.select("place", "snippet", "category", "state", F.inline("occurrences"))


@query("cat", """
    SELECT snippet, category, state, id, CASE state WHEN 'new' THEN 0 WHEN 'false_positive' THEN 1
        WHEN 'addressing' THEN 2 WHEN 'not_relevant' THEN 3 ELSE 4 END AS state_rank FROM cat""")
def ranked_occurrences(spark, sf_dir):
    found = reports.with_category(corpus.discoveries(spark, sf_dir), rules_table(spark))
    return reports.ranked_occurrences(found).select("snippet", "category", "state", "id", "state_rank")


@query("disc", f"SELECT id FROM disc WHERE repo_url = '{REPO}' ORDER BY id DESC LIMIT 5")
def newest_ids(spark, sf_dir):
    return reports.newest_ids(corpus.discoveries(spark, sf_dir), REPO, 5)


@query("disc", f"SELECT {DISCOVERY} FROM disc WHERE repo_url = '{REPO}' AND state IN ('new', 'fixed', 'addressing')")
def export_by_states(spark, sf_dir):
    return shown(reports.export_by_states(corpus.discoveries(spark, sf_dir), REPO, ["new", "fixed", "addressing"]))


@query("disc", """
    SELECT id::VARCHAR AS id, file_name, commit_id, line_number::VARCHAR AS line_number, snippet, state
    FROM disc ORDER BY disc.id LIMIT 30""")
def discoveries_preview(spark, sf_dir):
    return reports.preview(corpus.discoveries(spark, sf_dir))


# ---- models ---------------------------------------------------------------------

_CHAIN = {
    "chained": ("found", f"""
        SELECT * REPLACE (CASE WHEN by_path OR by_text THEN 'false_positive' ELSE state END AS state),
               CASE WHEN by_path THEN 'path' WHEN by_text THEN 'keyword' END AS flagged_by
        FROM (SELECT *, regexp_matches(lower(file_name), {oracles._text(paths.FALSE_POSITIVE_PATH)}) AS by_path,
                     rule_id = 5 AND contains(snippet, 'Apache') AS by_text FROM found)"""),
}


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path model, then a text model for password rules only."""
    models.register_model("keyword", models.column_model(lambda s: s.contains("Apache"), category="password"))
    return models.run_models(corpus.new_discoveries(spark, sf_dir), ["path", "unheard of", "keyword"], CORPUS_RULES)


@query("chained", f"SELECT {DISCOVERY}, flagged_by FROM chained", _CHAIN)
def model_chain(spark, sf_dir):
    return shown(_chained(spark, sf_dir), "flagged_by")


@query("chained", """
    SELECT flagged_by AS model, count(*) AS false_positives FROM chained WHERE flagged_by IS NOT NULL GROUP BY ALL""", _CHAIN)
def model_fp_counts(spark, sf_dir):
    return models.model_counts(_chained(spark, sf_dir))


@query()
def text_model_scores(spark, sf_dir):
    """A classifier learnt from the triaged discoveries, applied to the new ones."""
    found = corpus.stored_discoveries(spark, sf_dir)
    scored = models.text_scores(found.filter(F.col("state") == "new"), models.fit_text_model(found))
    return scored.select("id", "prediction", F.round("leak_probability", 3).alias("leak_probability"))


@query()
def snippet_vectors(spark, sf_dir):
    return models.embed_discoveries(corpus.new_discoveries(spark, sf_dir))


_BAYES = {
    "said": ("disc", r"""
        SELECT id, state, unnest(regexp_extract_all(lower(snippet), '[\pL\pN]+')) AS word FROM disc"""),
    "words": ("said", """
        SELECT word, count(*) FILTER (state <> 'false_positive') AS leaks, count(*) FILTER (state = 'false_positive') AS others
        FROM said WHERE state <> 'new' GROUP BY word"""),
    "sums": ("words", "SELECT count(*) AS v, sum(leaks) AS leaks, sum(others) AS others FROM words"),
    "weights": ("words,sums", """
        SELECT word, ln((w.leaks + 1.0::DOUBLE) / (s.leaks + s.v + 1)) - ln((w.others + 1.0::DOUBLE) / (s.others + s.v + 1)) AS weight
        FROM words w, sums s"""),
    "odds": ("said,weights", "SELECT id, sum(weight) AS total FROM said JOIN weights USING (word) WHERE state = 'new' GROUP BY id"),
    "prior": ("disc", """
        SELECT ln((count(*) FILTER (state <> 'false_positive') + 1.0::DOUBLE) / (count(*) FILTER (state = 'false_positive') + 1)) AS prior
        FROM disc WHERE state <> 'new'"""),
    "cut": ("found", """
        SELECT id, lower(replace(snippet, chr(39), chr(34))) AS s FROM found"""),
    "grams": ("cut", "SELECT id, md5(substr(s, k::INTEGER, 3)) AS h FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS k FROM cut)"),
    "places": ("grams", """
        SELECT id, ('0x' || h[1:8])::BIGINT % 128 AS place, sum(CASE WHEN h[9:9] < '8' THEN 1 ELSE -1 END) AS n
        FROM grams GROUP BY ALL"""),
}


@query("disc,odds,prior", """
    SELECT d.id, round(coalesce(o.total, 0) + p.prior, 6) AS log_odds
    FROM disc d LEFT JOIN odds o ON o.id = d.id, prior p WHERE d.state = 'new'""", _BAYES)
def naive_bayes_scores(spark, sf_dir):
    """A classifier from word counts of the triaged discoveries, applied to the new ones."""
    found = corpus.stored_discoveries(spark, sf_dir)
    model = bayes.fit_naive_bayes(found.filter(F.col("state") != "new"), F.col("state") != "false_positive")
    return bayes.log_odds(found.filter(F.col("state") == "new"), model).select("id", rounded("log_odds"))


@query("places", """
    SELECT id, place::INTEGER AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM places
    QUALIFY n <> 0""", _BAYES)
def hashed_vectors(spark, sf_dir):
    """Vectors of all discoveries by signed feature hashing, without their zeros."""
    encoded = models.embed_discoveries(corpus.new_discoveries(spark, sf_dir), bayes.signed_encoder())
    rows = encoded.select("id", F.posexplode("embedding").alias("place", "value"))
    return rows.filter("value <> 0").withColumn("value", F.round("value", 6))


@query("disc,emb", f"SELECT {DISCOVERY} FROM disc WHERE id NOT IN (SELECT id FROM emb)")
def missing_embeddings(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    return shown(models.without_embedding(found, corpus.embeddings(spark, sf_dir, found)))


# ---- similarity -----------------------------------------------------------------

TARGET = "Licensed under the Apache License, Version 2.0."
SIMILAR = 0.2


@query("", """
    SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) t ORDER BY 2 DESC, 1 LIMIT 50""")
def cosine_topk(spark, sf_dir):
    """The 50 vectors nearest to the first one."""
    stored = corpus.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    target = stored.filter(F.col("vec_id") == 0).select("v").scalar()
    compared = stored.withColumn("target", target)
    return (compared.select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("target")), 6).alias("similarity"))
            .orderBy(F.desc("similarity"), "vec_id").limit(50))


@query("", """
    SELECT vec_id, d::INTEGER AS dimension, round(avg(embedding[t * 8 + d + 1]::DOUBLE), 6) AS mean
    FROM embeddings, range(8) AS a(t), range(8) AS b(d) GROUP BY vec_id, d""")
def mean_pool(spark, sf_dir):
    """Every vector read as eight token vectors of width eight."""
    wide = F.col("embedding").cast("array<double>")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(wide, t * 8 + 1, F.lit(8)))
    stored = corpus.table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("tokens"))
    pooled = stored.select("vec_id", vectors.mean_pool(F.col("tokens")).alias("pooled"))
    return (pooled.select("vec_id", F.posexplode("pooled").alias("dimension", "mean"))
            .withColumn("mean", F.round("mean", 6)))


@query("emb", f"SELECT min(id) AS id, round(arg_min(list_sum(embedding), id), 6) AS total FROM emb WHERE snippet = '{TARGET}'")
def embedding_by_snippet(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    first = similarity.embedding_by_snippet(corpus.embeddings(spark, sf_dir, found), TARGET)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return first.select("id", F.round(total, 6).alias("total"))


_SIMILAR = {
    "target": ("emb", f"SELECT embedding FROM emb WHERE snippet = '{TARGET}' ORDER BY id LIMIT 1"),
    "alike": ("emb,target", f"""
        SELECT e.id, list_cosine_similarity(e.embedding, t.embedding) AS similarity
        FROM emb e, target t WHERE e.repo_url = '{REPO}'
                               AND list_cosine_similarity(e.embedding, t.embedding) > {SIMILAR}"""),
}


@query("alike", "SELECT id, round(similarity, 6) AS similarity FROM alike", _SIMILAR)
def similar_to_target(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    return (similarity.similar_to_target(corpus.embeddings(spark, sf_dir, found), TARGET, REPO, SIMILAR)
            .select("id", rounded("similarity")))


@query("disc,alike", f"""
    SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM alike) THEN 'addressing' ELSE state END AS state)
    FROM (SELECT {DISCOVERY} FROM disc)""", _SIMILAR)
def update_similar(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    return shown(triage.update_similar(found, corpus.embeddings(spark, sf_dir, found), TARGET, "addressing", REPO,
                                       threshold=SIMILAR))


@query("disc,alike", f"""
    SELECT * REPLACE (CASE WHEN repo_url = '{REPO}' AND snippet = '{TARGET}' OR id IN (SELECT id FROM alike)
                           THEN 'not_relevant' ELSE state END AS state)
    FROM (SELECT {DISCOVERY} FROM disc)""", _SIMILAR)
def update_group_and_similar(spark, sf_dir):
    """The group of a snippet and all that is similar to it, in one change of a store."""
    ws = Workspace(spark, shared_dir(spark, "store"))
    found = corpus.stored_discoveries(spark, sf_dir)
    batch = ws.store.new_batch()
    ws.store.put("embeddings", corpus.embeddings(spark, sf_dir, found), batch)
    ws.store.commit(batch, ["embeddings"])
    ws.add_discoveries(found)
    ws.update_group_and_similar(TARGET, "not_relevant", REPO, threshold=SIMILAR)
    return shown(ws.get_discoveries())


_REQUESTED = {
    "asked": ("emb", """
        SELECT min(id) AS request_id, repo_url, arg_min(snippet, id) AS snippet FROM emb GROUP BY repo_url"""),
    "vectors": ("emb", "SELECT snippet, arg_min(embedding, id) AS target FROM emb GROUP BY snippet"),
    "close": ("asked,vectors,emb", f"""
        SELECT a.request_id, a.repo_url, e.id, list_cosine_similarity(e.embedding, v.target) AS similarity
        FROM asked a JOIN vectors v ON a.snippet = v.snippet JOIN emb e ON e.repo_url = a.repo_url
        WHERE list_cosine_similarity(e.embedding, v.target) > {SIMILAR}"""),
}


def _requests(embeddings: DataFrame) -> DataFrame:
    """Every repository asks for what resembles its first embedded snippet."""
    return embeddings.groupBy("repo_url").agg(F.min("id").alias("request_id"), F.min_by("snippet", "id").alias("snippet"))


@query("close", "SELECT request_id, repo_url, id, round(similarity, 6) AS similarity FROM close", _REQUESTED)
def similarity_pairs(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    stored = corpus.embeddings(spark, sf_dir, found)
    return (similarity.similar_to_requests(stored, _requests(stored), SIMILAR)
            .select("request_id", "repo_url", "id", rounded("similarity")))


_VARIANTS = {"variants": ("", """
    SELECT vec_id * 10 + c AS id, list_transform(embedding::DOUBLE[], lambda x, i:
           x * (1 + 0.05::DOUBLE * c * ((i * 7 + vec_id) % 5 - 2))) AS v
    FROM embeddings, range(6) AS r(c)""")}
_CLOSE_PAIRS = """
    FROM (SELECT a.id AS request_id, b.id, list_cosine_similarity(a.v, b.v) AS similarity
          FROM variants a, variants b WHERE a.id % 100 = 0) WHERE similarity > 0.96"""


def _variant_index(spark, sf_dir):
    stored = corpus.vector_variants(spark, sf_dir)
    index = vector_index.VectorIndex.build(stored, shared_dir(spark, "vectors"), dimensions=64)
    return index, stored.filter(F.col("id") % 100 == 0)


@query("variants", "SELECT request_id, id, round(similarity, 6) AS similarity" + _CLOSE_PAIRS, _VARIANTS)
def similar_by_index(spark, sf_dir):
    """Every hundredth vector as a request to an index of all."""
    index, requests = _variant_index(spark, sf_dir)
    return index.similar(requests).select("request_id", "id", rounded("similarity"))


@query("variants", "SELECT request_id, count(*) AS similar, true AS enough" + _CLOSE_PAIRS + " GROUP BY request_id", _VARIANTS)
def similar_index_recall(spark, sf_dir):
    """What the index finds for every hundredth vector, held against a comparison with all: at least 0.9 of it."""
    index, requests = _variant_index(spark, sf_dir)
    return index.recall(requests).select("request_id", "similar", (F.col("found") >= F.col("similar") * 0.9).alias("enough"))


@query("disc,close", f"""
    SELECT * REPLACE (CASE WHEN id IN (SELECT id FROM close) THEN 'fixed' ELSE state END AS state)
    FROM (SELECT {DISCOVERY} FROM disc)""", _REQUESTED)
def update_similar_batch(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    stored = corpus.embeddings(spark, sf_dir, found)
    requests = _requests(stored).withColumn("state", F.lit("fixed"))
    return shown(triage.update_similar_batch(found, stored, requests, SIMILAR))


# ---- state changes --------------------------------------------------------------

@query("disc", f"""
    SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'fixed' ELSE state END AS state) FROM (SELECT {DISCOVERY} FROM disc)""")
def update_by_ids(spark, sf_dir):
    found = corpus.stored_discoveries(spark, sf_dir)
    return shown(triage.update_discoveries(found, found.filter(F.col("id") % 3 == 0).select("id"), "fixed"))


@query("disc", f"""
    SELECT * REPLACE (CASE WHEN repo_url = '{REPO}' AND snippet = '{TARGET}' THEN 'not_relevant' ELSE state END AS state)
    FROM (SELECT {DISCOVERY} FROM disc)""")
def update_group(spark, sf_dir):
    return shown(triage.update_discovery_group(corpus.discoveries(spark, sf_dir), "not_relevant", REPO, snippet=TARGET))


@query("disc", f"SELECT {DISCOVERY} FROM disc WHERE repo_url <> '{REPO}'")
def delete_discoveries(spark, sf_dir):
    return shown(triage.delete_discoveries(corpus.discoveries(spark, sf_dir), REPO))


@query("repos,disc,emb", """
    SELECT 'repos' AS kept, url AS repo_url, count(*) AS rows FROM repos WHERE last_scan IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'discoveries', repo_url, count(*) FROM disc
    WHERE repo_url IN (SELECT url FROM repos WHERE last_scan IS NOT NULL) GROUP BY ALL
    UNION ALL SELECT 'embeddings', repo_url, count(*) FROM emb
    WHERE repo_url IN (SELECT url FROM repos WHERE last_scan IS NOT NULL) GROUP BY ALL""")
def delete_repo_cascade(spark, sf_dir):
    """Drop every repository that was never scanned."""
    found = corpus.stored_discoveries(spark, sf_dir)
    repos = corpus.repos(spark, sf_dir)
    kept = triage.delete_repo(repos, found, corpus.embeddings(spark, sf_dir, found),
                              repos.filter(F.col("last_scan").isNull()).select("url"))
    counted = [frame.groupBy(F.lit(name).alias("kept"), F.col(url).alias("repo_url")).agg(F.count("*").alias("rows"))
               for frame, name, url in zip(kept, ("repos", "discoveries", "embeddings"), ("url", "repo_url", "repo_url"))]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("disc", f"""
    SELECT * REPLACE (CASE WHEN rule_id <> 2 THEN rule_id END AS rule_id) FROM (SELECT {DISCOVERY} FROM disc)""")
def delete_rule_setnull(spark, sf_dir):
    _, found = triage.delete_rules(rules_table(spark), corpus.discoveries(spark, sf_dir), [2])
    return shown(found)


@query("emb", f"""
    SELECT id, snippet, repo_url, len(embedding)::INTEGER AS width FROM emb WHERE repo_url <> '{REPO}' AND id <> 20302""")
def delete_embeddings(spark, sf_dir):
    left = triage.delete_embeddings(corpus.embeddings(spark, sf_dir), repo_url=REPO)
    return (triage.delete_embeddings(left, ids=[20302])
            .select("id", "snippet", "repo_url", F.size("embedding").alias("width")))


@query("repos,disc", """
    SELECT coalesce(r.url, d.url) AS url, coalesce(d.ts, r.last_scan) AS last_scan
    FROM (SELECT * FROM repos WHERE last_scan IS NULL OR last_scan % 7 <> 0) r
    FULL JOIN (SELECT repo_url AS url, max(ts) AS ts FROM disc GROUP BY ALL) d ON r.url = d.url""")
def repos_upsert(spark, sf_dir):
    """Known repositories advance to their latest discovery, unknown ones are added."""
    known = corpus.repos(spark, sf_dir).filter(F.col("last_scan").isNull() | (F.col("last_scan") % 7 != 0))
    news = corpus.discoveries(spark, sf_dir).select(F.col("repo_url").alias("url"),
                                                    F.unix_timestamp("timestamp").alias("last_scan"))
    return triage.upsert_repos(known, news)


# ---- stores, written to the shared folder and read back ---------------------------

@query("disc", f"SELECT {DISCOVERY} FROM disc")
def discoveries_append(spark, sf_dir):
    """Append twice: the second time no id is new."""
    path = shared_dir(spark, "discoveries")
    found = corpus.discoveries(spark, sf_dir)
    tables.append_new(found, path)
    tables.append_new(found, path)
    return shown(tables.read(spark, path))


@query("emb", """
    SELECT id, snippet, repo_url, len(embedding)::INTEGER AS width, round(list_sum(embedding), 6) AS total FROM emb""")
def embeddings_json_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "embeddings")
    stored = corpus.embeddings(spark, sf_dir)
    tables.export_json(stored.withColumn("embedding", vectors.to_json(F.col("embedding"))), path)
    back = spark.read.schema("id bigint, snippet string, embedding string, repo_url string").json(path)
    parsed = back.withColumn("embedding", vectors.from_json(F.col("embedding")))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return parsed.select("id", "snippet", "repo_url", F.size("embedding").alias("width"), F.round(total, 6).alias("total"))


@query("disc", f"SELECT {DISCOVERY} FROM disc")
def export_csv(spark, sf_dir):
    path = shared_dir(spark, "csv")
    tables.export_csv(corpus.discoveries(spark, sf_dir), path)
    return shown(tables.read_csv(spark, path, schemas.DISCOVERIES))


@query("disc", f"SELECT * REPLACE (CASE WHEN repo_url = '{REPO}' THEN 'new' ELSE state END AS state) FROM (SELECT {DISCOVERY} FROM disc)")
def forced_rescan(spark, sf_dir):
    """Rescan one repository of a triaged store from the start: its triage is gone, all
    other repositories keep theirs."""
    ws = Workspace(spark, shared_dir(spark, "store"))
    ws.store_scan(corpus.discoveries(spark, sf_dir), corpus.repos(spark, sf_dir))
    one = spark.createDataFrame([(REPO, 5)], "url string, last_scan bigint")
    ws.store_scan(corpus.new_discoveries(spark, sf_dir).filter(F.col("repo_url") == REPO), one, force=True)
    return shown(ws.get_discoveries())


@query("repos,disc", f"""
    SELECT r.url, r.last_scan, count(d.id) AS discoveries FROM repos r LEFT JOIN disc d ON d.repo_url = r.url
    WHERE r.url <> '{REPO}' GROUP BY ALL""")
def scan_atomicity(spark, sf_dir):
    """Scans that fail: a first one leaves no repository and no discovery, a forced one leaves what was there."""
    ws = Workspace(spark, shared_dir(spark, "store"))
    found, repos = tables.landed(corpus.discoveries(spark, sf_dir)), corpus.repos(spark, sf_dir)
    broken = found.withColumn("snippet", F.when(F.pmod("id", F.lit(7)) >= 0, F.raise_error(F.lit("the scan fails"))))
    is_one = F.col("repo_url") == REPO

    def fails(rows: DataFrame, scanned: DataFrame, **options) -> None:
        try:
            ws.store_scan(rows, scanned, **options)
        except PySparkException:
            return
        raise AssertionError("the scan should have failed")

    fails(broken, repos)
    ws.store_scan(found.filter(~is_one), repos.filter(F.col("url") != REPO))
    fails(broken, repos.filter(F.col("url") == REPO))
    fails(broken, repos, force=True)
    counts = ws.get_discoveries().groupBy(F.col("repo_url").alias("url")).agg(F.count("*").alias("discoveries"))
    return ws.get_repos().join(counts, "url", "left").select("url", "last_scan", F.coalesce("discoveries", F.lit(0)).alias("discoveries"))


_CHANGED = {
    "rounds": ("disc", """
        SELECT id, n, CASE n WHEN 1 THEN 'addressing' WHEN 2 THEN 'fixed' ELSE 'not_relevant' END AS state
        FROM disc, (VALUES (1), (2), (3)) AS r(n) WHERE id % (n + 1) = 0"""),
    "latest": ("rounds", "SELECT id, arg_max(state, n) AS state FROM rounds GROUP BY id"),
}


def _three_rounds(spark: SparkSession, sf_dir: str, ws: Workspace) -> DataFrame:
    """Store the discoveries and change the state of every second, then every third, then every fourth id."""
    found = tables.landed(corpus.discoveries(spark, sf_dir))
    ws.store_scan(found, corpus.repos(spark, sf_dir))
    for n, state in enumerate(("addressing", "fixed", "not_relevant"), 1):
        ws.update_discoveries(found.filter(F.pmod("id", F.lit(n + 1)) == 0).select("id"), state)
    return found


@query("disc,latest", f"""
    SELECT {DISCOVERY.replace("state", "coalesce(l.state, d.state) AS state").replace("id,", "d.id,", 1)}
    FROM disc d LEFT JOIN latest l ON l.id = d.id""", _CHANGED)
def state_log_fold(spark, sf_dir):
    """States after three rounds of changes, of which the last one of every discovery counts; half-way they are folded
    into the table."""
    ws = Workspace(spark, shared_dir(spark, "store"))
    _three_rounds(spark, sf_dir, ws)
    ws.store.compact()
    return shown(ws.get_discoveries())


@query("disc,latest", """
    SELECT repo_url, file_name, coalesce(l.state, d.state) AS state, count(*) AS n
    FROM disc d LEFT JOIN latest l ON l.id = d.id GROUP BY ALL""", _CHANGED)
def counts_from_deltas(spark, sf_dir):
    """Counts of every file and state after three rounds of changes and a repeated scan, added up from what each job changed."""
    ws = Workspace(spark, shared_dir(spark, "store"))
    found = _three_rounds(spark, sf_dir, ws)
    ws.store_scan(found, corpus.repos(spark, sf_dir))
    return ws.get_state_counts()


# ---- streams --------------------------------------------------------------------

@query("all_found", f"SELECT {DISCOVERY} FROM all_found", _ROWS)
def stream_scan(spark, sf_dir):
    """Patches arriving as a stream, scanned like a batch."""
    landed = shared_dir(spark, "patches")
    corpus.document_patches(spark, sf_dir).drop("doc_id").write.parquet(landed)
    target = shared_dir(spark, "discoveries")
    streams.scan_patch_stream(spark, landed, target, shared_dir(spark, "progress"), CORPUS_RULES, **corpus.shape())
    return shown(spark.read.schema(schemas.DISCOVERIES).parquet(target))


@query("unique_pairs", "SELECT repo_url, commit_id, parent_id FROM unique_pairs", _FIRST_BRANCH)
def stream_dedup(spark, sf_dir):
    """Commit pairs arriving as a stream, each let through once."""
    landed, target = shared_dir(spark, "pairs"), shared_dir(spark, "pairs-seen")
    (C.commit_pairs(corpus.commits(spark, sf_dir))
     .select(*C.PAIR, F.timestamp_seconds("committed_date").alias("seen_at")).write.parquet(landed))
    streams.unique_pair_stream(spark, landed, target, shared_dir(spark, "progress"))
    return spark.read.schema(streams.PAIRS).parquet(target).select(*C.PAIR)


@query("unique_pairs,pairs", """
    SELECT u.repo_url, u.commit_id, u.parent_id, p.last_scan
    FROM unique_pairs u JOIN (SELECT repo_url, max(committed_date)::BIGINT AS last_scan FROM pairs GROUP BY ALL) p USING (repo_url)""",
       _FIRST_BRANCH)
def stream_state(spark, sf_dir):
    """Pairs let through once and latest times, from keyed state: three runs, the oldest third last, then a restart."""
    landed, store, progress = (shared_dir(spark, name) for name in ("pairs", "pairs-state", "progress"))
    pairs = C.commit_pairs(corpus.commits(spark, sf_dir)).select(*C.PAIR, F.col("committed_date").alias("at"))
    spans = pairs.groupBy("repo_url").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    age = F.floor(3 * (F.col("at") - F.col("first")) / (F.col("last") - F.col("first") + 1)).cast("int")
    (pairs.join(spans, "repo_url").select(*C.PAIR, F.timestamp_seconds("at").alias("seen_at"), (3 - age).alias("turn"))
     .write.parquet(f"{landed}-all"))
    for turn in (1, 2, 3, None):
        if turn:
            (spark.read.parquet(f"{landed}-all").filter(F.col("turn") == turn).select(*streams.PAIRS.fieldNames())
             .write.mode("append").parquet(landed))
        streams.pair_state_stream(spark, landed, store, progress)
    return streams.stored_pairs(spark, store).select(*C.PAIR).join(
        streams.stored_scan_times(spark, store).withColumnRenamed("url", "repo_url"), "repo_url")


@query("repos,all_found", """
    SELECT r.url, coalesce(f.ts, r.last_scan) AS last_scan, coalesce(f.n, 0) AS discoveries
    FROM repos r LEFT JOIN (SELECT repo_url, max(ts) AS ts, count(*) AS n FROM all_found GROUP BY ALL) f
         ON r.url = f.repo_url""", _ROWS)
def stream_last_scan(spark, sf_dir):
    """A stream that stores discoveries and advances ``last_scan``, restarted once."""
    landed, store, progress = (shared_dir(spark, name) for name in ("patches", "store", "progress"))
    corpus.document_patches(spark, sf_dir).drop("doc_id").write.parquet(landed)
    for _ in range(2):
        streams.store_patch_stream(spark, landed, store, progress, CORPUS_RULES, **corpus.shape())
    counts = streams.stored_discoveries(spark, store).groupBy(F.col("repo_url").alias("url")).agg(
        F.count("*").alias("discoveries"))
    repos = triage.upsert_repos(corpus.repos(spark, sf_dir), streams.stored_scan_times(spark, store))
    return repos.join(counts, "url", "left").fillna(0, ["discoveries"])
