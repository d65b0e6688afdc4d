"""Column functions on lines, patch rows and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The row separators of a decoded patch, the whitespace a snippet is
# stripped of, and the hunk header of a unified diff.
PATCH_ROW_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLANK = r"[\s\x1c-\x1f]"
HUNK_HEADER = r"(?U)@@\s*\-\d+(\,\d+)?\s\+(\d+)((\,\d+)?).*@@"
MAX_ROW_LENGTH = 500


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def is_scannable_row(row: Column, max_length: int = MAX_ROW_LENGTH) -> Column:
    """Removed and overlong patch rows are never scanned."""
    return ~row.startswith("-") & (F.length(row) <= max_length)


def is_hunk_header(row: Column) -> Column:
    """A header whose line number is no 32-bit integer is an ordinary row."""
    return row.startswith("@@") & row.rlike(HUNK_HEADER) & hunk_first_line(row).isNotNull()


def hunk_first_line(row: Column) -> Column:
    return F.regexp_extract(row, HUNK_HEADER, 2).try_cast("int")


def patch_row_snippet(row: Column) -> Column:
    """An added row loses its sign and outer blanks; blank additions stay as they are."""
    trimmed = strip(F.substring(row, 2, 2147483647))
    return F.when(row.startswith("+") & (trimmed != ""), trimmed).otherwise(row)


def normalise_quotes(snippet: Column) -> Column:
    return F.translate(snippet, "'", '"')


# Fixed value: the wording of a finding in a report.
def finding_text(file_name: Column, snippet: Column, line_number: Column) -> Column:
    return F.concat(
        F.lit("file: "), file_name, F.lit("\nsecret: "), snippet,
        F.lit("\nline number: "), line_number.cast("string"), F.lit("\n" + "-" * 40))
