"""Scanning each content once, however many commits and forks hold it.

Files fall into classes of equal content. A store keeps one text for each class; only those texts are split into lines and
matched, and the matches are joined with the files of their class. Texts that the store knows already are neither stored
nor matched again: a later commit adds its new contents only.

A class is named by the SHA-256 of its bytes together with their number. A file without content has no class and no matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.operators.lines import file_lines
from keysieve.operators.matching import match_lines
from keysieve.operators.skew import salted_join
from keysieve.sources.rules import Rule

CLASS = ["content_sha256", "content_bytes"]
CONTENTS = T.StructType([T.StructField("content_sha256", T.StringType()), T.StructField("content_bytes", T.LongType()),
                         T.StructField("content", T.StringType())])


def with_class(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the class of the content to every file that has one."""
    named = {"content_sha256": F.sha2(F.col(content), 256), "content_bytes": F.octet_length(content).cast("long")}
    return files.filter(F.col(content).isNotNull()).withColumns(named)


class ContentStore:
    """One text for each class of content, in folders of parquet files below ``path``.

    Every call of ``add`` writes a folder of its own beside and then links it by one row in a list of folders, so a failed
    call adds nothing. One driver at a time adds.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._folders = T.StructType([T.StructField("folder", T.StringType())])
        spark.createDataFrame([], self._folders).write.mode("append").parquet(f"{path}/folders")

    def contents(self) -> DataFrame:
        folders = [r.folder for r in self.spark.read.schema(self._folders).parquet(f"{self.path}/folders").collect()]
        return self.spark.read.schema(CONTENTS).parquet(*folders) if folders else self.spark.createDataFrame([], CONTENTS)

    def add(self, files: DataFrame, content: str = "content") -> DataFrame:
        """Store the contents that are new and return them; copies in one task are merged before texts are moved."""
        classed = with_class(files, content)
        # Merged before the join, so the many files of one content don't meet in a task with their texts.
        merged = classed.groupBy(*CLASS).agg(F.first(content).alias("content"))
        unknown = merged.join(self.contents().select(*CLASS), CLASS, "left_anti")
        folder = f"{self.path}/part-{uuid.uuid4().hex}"
        unknown.write.parquet(folder)
        self.spark.createDataFrame([(folder,)], self._folders).coalesce(1).write.mode("append").parquet(f"{self.path}/folders")
        return self.spark.read.schema(CONTENTS).parquet(folder)

    def matches(self, rules: Sequence[Rule], contents: DataFrame | None = None) -> DataFrame:
        """(class, line_number, snippet, rule_id) of all stored contents, or of some."""
        stored = self.contents() if contents is None else contents
        return match_lines(file_lines(stored, "content", rules), rules).select(*CLASS, "line_number", "snippet", "rule_id")

    def scan(self, files: DataFrame, rules: Sequence[Rule], content: str = "content", spread: Column | None = None) -> DataFrame:
        """One row for each file and match, with the columns of ``files`` but the content. The contents must be stored.

        Only names of classes meet the matches. The files of one class are spread by ``spread``, by default by all
        their columns.
        """
        keep = [c for c in files.columns if c != content]
        members = with_class(files, content).select(*keep, *CLASS)
        hot = F.struct(*keep) if spread is None else spread
        return salted_join(members, self.matches(rules), CLASS, hot).drop(*CLASS)
