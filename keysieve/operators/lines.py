"""From whole files and whole patches to numbered lines, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.functions import text as X
from keysieve.operators.matching import may_match
from keysieve.sources.rules import Rule


def decode_utf8(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace binary content by text and drop the files that are not UTF-8."""
    return (files.withColumn(content, F.try_validate_utf8(F.col(content).cast("string")))
            .filter(F.col(content).isNotNull()))


def file_lines(files: DataFrame, content: str = "content", rules: Sequence[Rule] = ()) -> DataFrame:
    """One row per line of a decoded file.

    ``match_text`` is what rules are tested on: the untrimmed line with its newline,
    if it has one. ``snippet`` is what a discovery reports: the stripped line. With
    ``rules`` given, files and lines that cannot match are left out early.
    """
    keep = [c for c in files.columns if c != content]
    unified = F.replace(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    texts = files.select(*keep, unified.alias("_text"))
    if rules:
        texts = texts.filter(may_match(F.col("_text"), rules))
    pieces = (texts.select(*keep, F.split("_text", "\n", -1).alias("_pieces"))
              .select(*keep, "_pieces", F.size("_pieces").alias("_n")))
    rows = pieces.select(*keep, "_n", F.posexplode_outer("_pieces").alias("_pos", "_line"))
    ended = F.col("_pos") < F.col("_n") - 1
    present = ended | (F.col("_line") != "")
    whole = F.when(ended, F.concat("_line", F.lit("\n"))).otherwise(F.col("_line"))
    if rules:
        present = present & may_match(whole, rules)     # a rule may need the newline
    return (
        rows.filter(present)
        .select(*keep, (F.col("_pos") + 1).alias("line_number"), whole.alias("match_text"),
                X.strip(F.col("_line")).alias("snippet"))
    )


def _split_rows(patch: Column) -> Column:
    return F.split(patch, X.PATCH_ROW_BREAK, -1)


def _header_places(kept: Column) -> Column:
    """The 0-based places of the hunk headers among the kept rows."""
    return F.filter(F.transform(kept, lambda row, i: F.when(X.is_hunk_header(row), i)),
                    lambda i: i.isNotNull())


def patch_lines(patches: DataFrame, patch: str = "patch", rules: Sequence[Rule] = (),
                count_long_rows: bool = False) -> DataFrame:
    """One row per scanned row of a patch, numbered on the new side.

    Removed rows and rows over 500 characters are skipped and, like hunk headers, do
    not advance the line number. ``count_long_rows`` makes overlong rows advance it,
    which is where the line really is in the file.

    A patch stays one row until its rows are final: it is split, filtered and cut into
    hunks with array functions, so numbering needs neither a window nor a shuffle.
    With ``rules`` given, patches and rows that cannot match are left out early.
    """
    if rules:
        patches = patches.filter(may_match(F.col(patch), rules))
    keep = [c for c in patches.columns if c != patch]
    rows = patches.select(*keep, _split_rows(F.col(patch)).alias("_rows"))
    size = F.size("_rows")
    without_tail = F.when(F.element_at("_rows", -1) == "", F.slice("_rows", F.lit(1), size - 1)).otherwise(F.col("_rows"))
    limit = 2147483647 if count_long_rows else X.MAX_ROW_LENGTH
    kept = rows.select(*keep, F.filter(without_tail, lambda row: X.is_scannable_row(row, limit)).alias("_kept"))
    # Cut the kept rows at their hunk headers. A row's line number is the header's plus
    # its place in the hunk; rows ahead of the first header count from 1.
    marked = kept.select(*keep, "_kept", _header_places(F.col("_kept")).alias("_headers"))
    hunks = marked.select(*keep, F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col("_headers")),
        F.concat(F.col("_headers"), F.array(F.size("_kept"))),
        lambda start, end: F.struct(
            F.when(start < 0, F.lit(1)).otherwise(X.hunk_first_line(F.get(F.col("_kept"), start))).alias("first_line"),
            F.slice("_kept", start + 2, end - start - 1).alias("rows"))).alias("_hunks"))
    numbered = (
        hunks.select(*keep, F.inline_outer("_hunks"))
        .select(*keep, "first_line", F.posexplode_outer("rows").alias("_pos", "row"))
        .filter(F.col("row").isNotNull())
    )
    if rules:
        numbered = numbered.filter(may_match(F.col("row"), rules))
    if count_long_rows:
        numbered = numbered.filter(F.length("row") <= X.MAX_ROW_LENGTH)
    snippet = X.patch_row_snippet(F.col("row"))
    return (numbered.select(*keep, (F.col("first_line") + F.col("_pos")).alias("line_number"), "row",
                            snippet.alias("snippet"))
            .withColumn("match_text", F.col("snippet")))


def hunk_headers(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Every hunk header of a patch with its new-side first line."""
    keep = [c for c in patches.columns if c != patch]
    rows = patches.select(*keep, F.posexplode_outer(_split_rows(F.col(patch))).alias("row_number", "row"))
    return (rows.filter(X.is_scannable_row(F.col("row")) & X.is_hunk_header(F.col("row")))
            .select(*keep, "row_number", X.hunk_first_line(F.col("row")).alias("first_line")))
