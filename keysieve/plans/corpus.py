"""The library's tables derived from a document corpus.

Documents play the files of repositories: the source is the repository, every document
is a file that one commit adds. All other tables follow from that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.operators import tables
from keysieve.operators.skew import dense_positions, spread
from keysieve.plans import scans
from keysieve.schemas import CATEGORIES, STATES
from keysieve.sources import commits as C
from keysieve.sources.rules import Rule
from keysieve.sources.trees import open_root

HOST = "https://git.example/"
EPOCH = 1704067200

# What the corpus can be searched for; every category occurs.
CORPUS_RULES = [
    Rule(1, r'token\s*=\s*"[0-9a-f]{40}"', "token", "hex token"),
    Rule(2, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "other", "mail address"),
    Rule(3, r"\(\d{3}\) \d{3}-\d{4}", "other", "phone number"),
    Rule(4, r"\b\d{1,3}(\.\d{1,3}){3}\b", "other", "network address"),
    Rule(5, r"copyright|licensed under|spdx", "password", "notice keywords"),
    Rule(6, r"\b[0-9]{16}\b", "crypto_key", "card number"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_remainder(number: Column, values: tuple) -> Column:
    """The value at place ``number`` modulo their count."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def _name(doc_id: Column) -> Column:
    doc = doc_id.cast("string")
    shapes = [("src/app_", ".py"), ("tests/t_", ".py"), ("docs/", ".md"), ("web/", ".css"), ("lib/a/b/", ".txt")]
    return F.get(F.array(*[F.concat(F.lit(a), doc, F.lit(b)) for a, b in shapes]),
                 F.pmod(F.floor(doc_id / 7), F.lit(5)).cast("int"))


def _keys(documents: DataFrame) -> list[Column]:
    return [F.col("doc_id"),
            F.concat(F.lit(HOST), F.col("source")).alias("repo_url"),
            F.md5(F.concat("source", F.col("doc_id").cast("string"))).alias("commit_id"),
            (F.lit(EPOCH) + F.col("doc_id") * 60).alias("committed_date"),
            _name(F.col("doc_id")).alias("file_name")]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return documents.select(*_keys(documents), F.col("text").alias("content"))


def write_tree(files: DataFrame, root: str) -> None:
    """Write every (file_name, content) as a file below ``root``, a folder that all executors share."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = open_root(root)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{row['file_name']}"
                target.create_dir(path.rsplit("/", 1)[0])
                with target.open_output_stream(path) as stream:
                    stream.write((row["content"] or "").encode())
        yield from ()

    files.select("file_name", "content").mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()


def edited(content: Column, doc_id: Column) -> Column:
    """The text with every ninth line gone, every ninth replaced and a line put in behind every fourteenth."""
    def lines(line: Column, i: Column) -> Column:
        mark = F.concat(doc_id.cast("string"), F.lit("."), (i + 1).cast("string"))
        fresh = F.when(i % 2 == 0, F.concat(F.lit("mail m"), mark, F.lit("@h.org"))).otherwise(F.concat(F.lit("line "), mark))
        return (F.when(i % 9 == 3, F.array().cast("array<string>")).when(i % 9 == 6, F.array(fresh))
                .when(i % 14 == 2, F.array(line, fresh)).otherwise(F.array(line)))
    return F.array_join(F.flatten(F.transform(F.split(content, "\n", -1), lines)), "\n")


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of every repository, ``old`` and ``new``: files are edited, and some unchanged, added or deleted."""
    doc = F.col("doc_id")
    text = F.when(doc % 5 == 0, F.col("content")).otherwise(edited(F.col("content"), doc))
    sides = F.array_compact(F.array(
        F.when(doc % 11 != 0, F.struct(F.lit("old").alias("side"), F.col("content").alias("text"))),
        F.when(doc % 13 != 0, F.struct(F.lit("new").alias("side"), text.alias("text")))))
    return (files(spark, sf_dir).select("doc_id", "repo_url", "file_name", F.inline(sides))
            .select("repo_url", F.md5(F.concat("repo_url", "side")).alias("commit_id"), "file_name", F.col("text").alias("content")))


def snapshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "documents").select(F.concat(F.lit(HOST), "source").alias("repo_url")).distinct()
    side = lambda name: F.md5(F.concat("repo_url", F.lit(name)))
    return urls.select("repo_url", side("old").alias("commit_from"), side("new").alias("commit_id"))


def vector_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding): every vector and five that move further and further away from it; ids of originals end in 0."""
    def moved(x: Column, i: Column) -> Column:
        return x * (F.lit(1.0) + F.lit(0.05) * F.col("c") * (F.pmod((i + 1) * 7 + F.col("vec_id"), F.lit(5)) - 2))
    stored = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"),
                                                       F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c"))
    return stored.select((F.col("vec_id") * 10 + F.col("c")).alias("id"), F.transform("v", moved).alias("embedding"))


def forked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file as often as commits and forks hold it: once more in a fork of every repository, and two out of three
    once more in a fork of that."""
    forks = F.array_compact(F.array(F.lit(""), F.lit("-fork"), F.when(F.col("doc_id") % 3 > 0, F.lit("-fork-fork"))))
    return files(spark, sf_dir).withColumn("fork", F.explode(forks)).withColumn("repo_url", F.concat("repo_url", "fork")).drop("fork")


def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(*_keys(documents))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch main has every document of a source, branch dev every third document."""
    keys = file_keys(spark, sf_dir).select("repo_url", "doc_id", "commit_id", "committed_date")
    placed = keys.withColumn("branch", F.explode(
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("main"), F.lit("dev"))).otherwise(F.array(F.lit("main")))))
    numbered = dense_positions(placed, C.BRANCH, "doc_id")
    return numbered.select("repo_url", "branch", "pos", "commit_id", "committed_date")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = commits(spark, sf_dir).filter(F.col("pos") == 0)
    named = heads.withColumn("ref_name", F.explode(F.array(
        F.concat(F.lit("refs/heads/"), "branch"), F.concat(F.lit("refs/remotes/origin/"), "branch"))))
    return named.select("repo_url", "ref_name", "commit_id")


def patch_text(content: Column) -> Column:
    """A patch that adds the lines, with some as removed and some as context rows and
    a new hunk every eleven lines."""
    def row(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        header = F.when(i % 11 == 0, F.concat(F.lit("@@ -"), number, F.lit(",11 +"), number, F.lit(",11 @@\n")))
        sign = F.when(i % 7 == 3, "-").when(i % 7 == 5, " ").otherwise("+")
        return F.concat(F.coalesce(header, F.lit("")), sign, line)
    return F.array_join(F.transform(F.split(content, "\n", -1), row), "\n")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per commit pair of a branch, and one per first commit."""
    chain = C.commit_chain(commits(spark, sf_dir)).select(*C.PAIR).distinct()
    doc = F.col("doc_id")
    change = by_remainder(doc, ("D", "R", "M", "M", "M", "A", "A", "A", "A", "A"))
    binary = F.concat(F.lit("Binary files /dev/null and b/"), "file_name", F.lit(" differ"))
    text = F.when(doc % 17 == 0, binary).otherwise(patch_text(F.col("content")))
    touched = files(spark, sf_dir).select(
        "repo_url", "commit_id", "committed_date", change.alias("change_type"),
        F.when(doc % 10 < 5, F.col("file_name")).alias("a_path"),
        F.when(doc % 10 > 0, F.col("file_name")).alias("b_path"), text.alias("patch"))
    return touched.join(chain, ["repo_url", "commit_id"]).select(
        "repo_url", "commit_id", "parent_id", "committed_date", "change_type", "a_path", "b_path", "patch")


def document_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per document, without regard to commit chains."""
    return files(spark, sf_dir).select("doc_id", "repo_url", "commit_id", "file_name",
                                       patch_text(F.col("content")).alias("patch"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pull-request commit document (JSON text) per document; every ninth file has
    no patch."""
    document = F.to_json(F.struct(
        "repo_url", (F.col("doc_id") % 50).cast("int").alias("pr_number"), F.col("commit_id").alias("sha"),
        F.array(
            F.struct(F.col("file_name").alias("filename"),
                     F.when(F.col("doc_id") % 9 != 0, F.col("patch")).alias("patch")),
            F.struct(F.lit("empty.txt").alias("filename"), F.lit(None).cast("string").alias("patch"))).alias("files")))
    return document_patches(spark, sf_dir).select(document.alias("value"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source; those whose newest document number is a multiple of 4 were
    never scanned."""
    newest = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("doc"))
    return newest.select(F.concat(F.lit(HOST), F.col("source")).alias("url"),
                         F.when(F.col("doc") % 4 != 0, F.lit(EPOCH) + F.col("doc") * 60).alias("last_scan"))


def document_number() -> Column:
    return F.regexp_extract("file_name", r"([0-9]+)\.", 1).cast("bigint")


def shape() -> dict:
    """Ids and times that follow from the row, so that results can be compared."""
    number = document_number()
    ids = number * 10000000 + F.col("line_number") * 100 + F.col("rule_id")
    return {"ids": ids, "discovered": F.timestamp_seconds(F.lit(EPOCH) + number * 60)}


def new_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_files(files(spark, sf_dir), CORPUS_RULES, **shape())


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's discoveries as if triaged, the state following from the line number."""
    return new_discoveries(spark, sf_dir).withColumn("state", by_remainder(F.col("line_number"), STATES))


def stored_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triaged discoveries as a table, for jobs that read it more than once."""
    return tables.landed(discoveries(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Vectors of those discoveries whose document has one."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = discoveries(spark, sf_dir) if found is None else found
    return (found.withColumn("doc_id", document_number()).join(vectors, "doc_id")
            .select("id", "snippet", "embedding", "repo_url"))


def rule_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document submits its first word as a rule; many words repeat."""
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        F.col("doc_id").cast("int").alias("id"),
        F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("regex"),
        by_remainder(F.col("doc_id"), CATEGORIES).alias("category"), F.col("lang").alias("description"))
