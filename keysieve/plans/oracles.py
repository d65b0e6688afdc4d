"""The registered queries as SQL text for another engine.

Each query names the shared table expressions it needs; they are put in front of it.
The SQL states the results independently of how the Spark jobs reach them: line
numbers and winners, for example, come from window functions here.
"""

from __future__ import annotations

import re

from keysieve.functions.paths import FALSE_POSITIVE_PATH
from keysieve.plans.corpus import CORPUS_RULES, EPOCH, HOST
from keysieve.schemas import CATEGORIES, STATES
from keysieve.sources.rules import DEFAULT_RULES

_WHITE = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
          r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


def _pick(number: str, values: tuple) -> str:
    cases = " ".join(f"WHEN {i} THEN {_text(v)}" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


def _re2(regex: str) -> str:
    return _text("(?i)(?:" + regex.replace(r"[\W_]", r"[^\pL\pN]") + ")")


def _matches(source: str, keep: str, rules=CORPUS_RULES) -> str:
    """Every (row, rule) match of ``source.match_text``."""
    return " UNION ALL ".join(
        f"SELECT {keep}, {rule.id}::INTEGER AS rule_id, "
        f"length(match_text) - length(string_split_regex(match_text, {_re2(rule.regex)})[-1]) AS match_end "
        f"FROM {source} WHERE regexp_matches(match_text, {_re2(rule.regex)})" for rule in rules)


_RULE_ROWS = ", ".join(
    f"({r.id}, {_text(r.regex)}, {_text(r.category)}, {_text(r.description)})" for r in CORPUS_RULES)

_DISCOVERY = "id, file_name, commit_id, line_number, snippet, repo_url, rule_id, state, ts"
_ID = "doc_id * 10000000 + line_number * 100 + rule_id"
_PATCH_BREAK = r"'\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]'"
_HEADER = r"'@@\s*-[0-9]+(,[0-9]+)?\s\+([0-9]+)((,[0-9]+)?).*@@'"

# name -> (needed expressions, body)
_TABLES: dict[str, tuple[str, str]] = {
    "files": ("", f"""
        SELECT doc_id, lang, '{HOST}' || source AS repo_url, md5(source || doc_id::VARCHAR) AS commit_id,
               {EPOCH} + doc_id * 60 AS committed_date,
               CASE (doc_id // 7) % 5 WHEN 0 THEN 'src/app_' || doc_id || '.py' WHEN 1 THEN 'tests/t_' || doc_id || '.py'
                    WHEN 2 THEN 'docs/' || doc_id || '.md' WHEN 3 THEN 'web/' || doc_id || '.css'
                    ELSE 'lib/a/b/' || doc_id || '.txt' END AS file_name, text AS content
        FROM documents"""),
    "rules": ("", f"SELECT * FROM (VALUES {_RULE_ROWS}) AS r(id, regex, category, description)"),
    "pieces": ("files", r"""
        SELECT * EXCLUDE (content),
               string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p
        FROM files"""),
    "raw_lines": ("pieces", """
        SELECT * EXCLUDE (p), unnest(p) AS line, generate_subscripts(p, 1)::INTEGER AS line_number, len(p) AS n
        FROM pieces"""),
    "lines": ("raw_lines", f"""
        SELECT * EXCLUDE (n), line || CASE WHEN line_number < n THEN chr(10) ELSE '' END AS match_text,
               {_strip('line')} AS snippet
        FROM raw_lines WHERE line_number < n OR line <> ''"""),
    "line_matches": ("lines", _matches("lines", "doc_id, repo_url, commit_id, file_name, line_number, snippet")),
    "found": ("line_matches", f"""
        SELECT {_ID} AS id, doc_id, file_name, commit_id, line_number, snippet, repo_url, rule_id, 'new' AS state,
               {EPOCH} + doc_id * 60 AS ts, match_end
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_number
                                           ORDER BY match_end DESC, rule_id DESC) AS place FROM line_matches)
        WHERE place = 1"""),
    "disc": ("found", f"SELECT * REPLACE ({_pick('line_number', STATES)} AS state) FROM found"),
    "cat": ("disc,rules", """
        SELECT d.*, coalesce(r.category, '(rule deleted)') AS category
        FROM disc d LEFT JOIN rules r ON d.rule_id = r.id"""),
    "emb": ("disc", """
        SELECT d.id, d.snippet, e.embedding::DOUBLE[] AS embedding, d.repo_url
        FROM disc d JOIN embeddings e ON d.doc_id = e.vec_id"""),
    "repos": ("", f"""
        SELECT '{HOST}' || source AS url,
               CASE WHEN max(doc_id) % 4 <> 0 THEN {EPOCH} + max(doc_id) * 60 END AS last_scan
        FROM documents GROUP BY source"""),
    "commits": ("files", """
        SELECT repo_url, branch, row_number() OVER (PARTITION BY repo_url, branch ORDER BY doc_id DESC) - 1 AS pos,
               commit_id, committed_date
        FROM (SELECT *, 'main' AS branch FROM files UNION ALL SELECT *, 'dev' FROM files WHERE doc_id % 3 = 0)"""),
    "chain": ("commits", """
        SELECT *, lead(commit_id) OVER (PARTITION BY repo_url, branch ORDER BY pos) AS parent_id FROM commits"""),
    "pairs": ("chain", "SELECT * FROM chain WHERE parent_id IS NOT NULL"),
    "refs": ("commits", """
        SELECT repo_url, prefix || branch AS ref_name, commit_id
        FROM commits, (VALUES ('refs/heads/'), ('refs/remotes/origin/')) AS p(prefix) WHERE pos = 0"""),
    "doc_patches": ("files", """
        SELECT * EXCLUDE (content), array_to_string(list_transform(string_split(content, chr(10)), lambda x, i:
               CASE WHEN (i - 1) % 11 = 0 THEN '@@ -' || i || ',11 +' || i || ',11 @@' || chr(10) ELSE '' END ||
               CASE (i - 1) % 7 WHEN 3 THEN '-' WHEN 5 THEN ' ' ELSE '+' END || x), chr(10)) AS patch
        FROM files"""),
    "patches": ("doc_patches,chain", f"""
        SELECT d.doc_id, d.repo_url, d.commit_id, c.parent_id, d.committed_date,
               {_pick('d.doc_id', ("D", "R", "M", "M", "M", "A", "A", "A", "A", "A"))} AS change_type,
               CASE WHEN d.doc_id % 10 < 5 THEN file_name END AS a_path,
               CASE WHEN d.doc_id % 10 > 0 THEN file_name END AS b_path,
               CASE WHEN d.doc_id % 17 = 0 THEN 'Binary files /dev/null and b/' || file_name || ' differ'
                    ELSE patch END AS patch
        FROM doc_patches d JOIN (SELECT DISTINCT repo_url, commit_id, parent_id FROM chain) c
             ON d.repo_url = c.repo_url AND d.commit_id = c.commit_id"""),
    "text_patches": ("patches", """
        SELECT doc_id, repo_url, commit_id, parent_id, committed_date, change_type,
               coalesce(b_path, a_path) AS file_name, patch
        FROM patches WHERE NOT starts_with(patch, 'Binary files')"""),
    "pair_patches": ("text_patches", """
        SELECT * FROM text_patches WHERE parent_id IS NOT NULL AND change_type IN ('A', 'M')"""),
    "submissions": ("", f"""
        SELECT doc_id::INTEGER AS id, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS regex,
               {_pick('doc_id', CATEGORIES)} AS category, lang AS description FROM documents"""),
    "catalogue": ("submissions", """
        SELECT id, regex, category, description
        FROM (SELECT *, row_number() OVER (PARTITION BY regex ORDER BY id) AS place FROM submissions)
        WHERE place = 1"""),
}


def patch_scan(name: str, source: str, rules=CORPUS_RULES) -> dict[str, tuple[str, str]]:
    """Table expressions that number, trim and match the rows of the patches in
    ``source`` (doc_id, repo_url, commit_id, parent_id, file_name, patch)."""
    key = "doc_id, repo_url, commit_id, parent_id, file_name"
    return {
        f"{name}_rows": (source, f"""
            SELECT * FROM (
                SELECT {key}, unnest(r) AS row, generate_subscripts(r, 1) AS k, len(r) AS n
                FROM (SELECT {key}, string_split_regex(patch, {_PATCH_BREAK}) AS r FROM {source}))
            WHERE NOT (k = n AND row = '')"""),
        f"{name}_kept": (f"{name}_rows", f"""
            SELECT *, starts_with(row, '@@') AND regexp_matches(row, {_HEADER}) AS is_header
            FROM {name}_rows WHERE NOT starts_with(row, '-') AND length(row) <= 500"""),
        f"{name}_hunks": (f"{name}_kept", f"""
            SELECT *, sum(is_header::INTEGER) OVER (PARTITION BY {key} ORDER BY k) AS hunk FROM {name}_kept"""),
        f"{name}_numbered": (f"{name}_hunks", f"""
            SELECT {key}, k, row, is_header,
                   (coalesce(max(CASE WHEN is_header THEN regexp_extract(row, {_HEADER}, 2)::INTEGER END)
                             OVER (PARTITION BY {key}, hunk), 1)
                    + sum((NOT is_header)::INTEGER) OVER (PARTITION BY {key}, hunk ORDER BY k) - 1)::INTEGER
                       AS line_number
            FROM {name}_hunks"""),
        f"{name}_lines": (f"{name}_numbered", f"""
            SELECT * EXCLUDE (is_header), snippet AS match_text FROM (
                SELECT *, CASE WHEN starts_with(row, '+') AND {_strip('substr(row, 2)')} <> ''
                               THEN {_strip('substr(row, 2)')} ELSE row END AS snippet
                FROM {name}_numbered WHERE NOT is_header)"""),
        f"{name}_matches": (f"{name}_lines", _matches(
            f"{name}_lines", f"{key}, k, line_number, snippet", rules)),
        f"{name}_found": (f"{name}_matches", f"""
            SELECT {_ID} AS id, file_name, commit_id, line_number, snippet, repo_url, rule_id, 'new' AS state,
                   {EPOCH} + doc_id * 60 AS ts
            FROM (SELECT *, row_number() OVER (PARTITION BY {key}, k ORDER BY match_end DESC, rule_id DESC) AS place
                  FROM {name}_matches) WHERE place = 1"""),
    }


def expand(needs: str, body: str, extra: dict[str, tuple[str, str]] | None = None) -> str:
    """The query text with its table expressions in front, each after those it needs."""
    tables = {**_TABLES, **(extra or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name and name not in ordered:
            for needed in tables[name][0].split(","):
                visit(needed)
            ordered.append(name)

    for name in needs.split(","):
        visit(name)
    parts = ", ".join(f"{name} AS ({tables[name][1]})" for name in ordered)
    text = f"WITH {parts} {body}" if parts else body
    return re.sub(r"\n\s+", "\n", text)
