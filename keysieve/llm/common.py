"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.session import shared_dir

# Word separators: space and the control characters from tab to carriage return.
SEPARATORS = "\t\n\v\f\r"


def split_words(text: str) -> list[str]:
    """The maximal runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    for c in SEPARATORS:
        if c in text:
            text = text.replace(c, " ")
    words = text.split(" ")
    return [w for w in words if w] if "" in words else words


def landed(frame: DataFrame, purpose: str = "llm") -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage for good."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no column of the input clashes with."""
    taken = {t.lower() for t in taken}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
