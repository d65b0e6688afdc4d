"""Column functions for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of the states and the order states are listed in.
STATE_LABELS = {
    "new": "leak",
    "false_positive": "false positive",
    "addressing": "addressing",
    "not_relevant": "not relevant",
}
STATE_RANKS = {"new": 0, "false_positive": 1, "addressing": 2, "not_relevant": 3, "fixed": 4}
RULE_DELETED = "(rule deleted)"


def _lookup(values: dict, key: Column) -> Column:
    choice = None
    for name, value in values.items():
        choice = (F if choice is None else choice).when(key == name, F.lit(value))
    return choice


def state_label(state: Column) -> Column:
    """The display name; a state without one is shown as it is."""
    return F.coalesce(_lookup(STATE_LABELS, state), state)


def state_rank(state: Column) -> Column:
    return _lookup(STATE_RANKS, state)


def scan_time(last_scan: Column) -> Column:
    """Epoch seconds as ``YYYY/MM/DD HH:MM:SS`` in UTC; 'Never' without a scan."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=last_scan)
    return F.when(last_scan != 0, F.translate(utc.cast("string"), "-", "/")).otherwise("Never")
