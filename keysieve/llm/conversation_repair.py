"""Structure repair of conversations: the cheapest edits that make the roles read (system) user assistant user assistant ...

The edits of a conversation are paths through a lattice: one layer for each gap between rows, and in it the four states of
the pattern (s?(ua)+)?. An auction finds shortest paths: node prices start as lower bounds that no arc violates, a path
grows along an arc whose cost the prices explain, and where there is none the price of its end rises and the path shrinks.
Converged prices are dual: exactly the arcs of shortest paths stay tight, and the least path in letters is read off them.

A conversation of any length is cut into blocks. The auction runs inside blocks, for each state behind the block as a
destination; a small table of costs for each block then tells which states a cheapest path of all blocks passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm.common import landed
from keysieve.operators.skew import salted_join

# States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. 0 and 3 may end.
NEXT = (2, 2, 3, 2)                         # where a user or assistant row, whichever fits, leads
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ENDINGS = ((0, ""), (10, "II"), (5, "I"), (0, ""))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {2: "user", 3: "assistant"}
INF = 1 << 60
BLOCK_ROWS, BLOCK_CHARS = 128, 24_000
SPACE = " \t\n\v\f\r"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults put in by crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its
    text, 2 removes ``. ! ?``, 3 repeats it, 4 makes it a user's. A null counts as one space."""
    def written(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(written(conv), F.lit(":"), written(turn)).cast("binary")) % 20
    body = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(written(text), "[.!?]", "")).otherwise(written(text))
    return (rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.when(draw == 4, F.lit("user")).otherwise(written(role)).alias("role"), body.alias("text"),
                        draw.alias("_draw"))
            .filter("_draw <> 0")
            .select("conv", "turn", "role", "text", F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1)))
                                                              .otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy"))


# ---- the auction


def _arcs(pattern: str, layer: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, layer, state) of the arcs out of a node, in the order of their letters."""
    if layer == len(pattern):
        return
    kind = pattern[layer]
    yield "D", DELETE, layer + 1, state
    yield "I", INSERT, layer, NEXT[state]
    if kind == "D":
        return
    more = TRUNCATED if kind.islower() else 0
    kept = KEPT.get(kind.lower(), (None,) * 4)[state]
    if kept is not None:
        yield "K", KEEP + more, layer + 1, kept
    yield "R", REROLE + more, layer + 1, NEXT[state]


def auction(pattern: str, goal: int) -> dict[tuple[int, int], int]:
    """The converged prices: the cost of the cheapest edits from every node to state ``goal`` behind the last row.

    Nodes that can't reach the goal have the price INF. Origins are taken from the last layer backwards. A path that
    meets a node of an earlier path is complete, as that one goes on to the goal over tight arcs.
    """
    last = len(pattern)
    states = {0: (0,), 1: (1, 0)}.get(goal, (3, 2, 1, 0))     # those from which the goal can be met at all
    price: dict[tuple[int, int], int] = {}
    least = 0
    for layer in range(last, -1, -1):
        # What each row costs at least, whatever the roles: no arc costs less than the prices of its ends differ.
        if layer < last:
            least += 0 if pattern[layer].isupper() and pattern[layer] != "D" else DELETE
        for state in states:
            price[layer, state] = least if layer < last else (0 if state == goal else INF)
    met = {(last, state) for state in states}
    for layer in range(last - 1, -1, -1):
        for state in states:
            path = [(layer, state)]
            while path[-1] not in met:
                node = path[-1]
                bid, onward = INF, None
                for _, cost, *ahead in _arcs(pattern, *node):
                    offer = cost + price.get((ahead[0], ahead[1]), INF)
                    if offer < bid:
                        bid, onward = offer, (ahead[0], ahead[1])
                if onward is None or bid >= INF:
                    price[node] = INF                        # a dead end
                    met.add(node)
                    path.pop()
                    if not path:
                        break
                elif price[node] < bid:
                    price[node] = bid                        # contraction
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(onward)                      # extension along a tight arc
            met.update(path)
    return price


@lru_cache(maxsize=8192)
def options(pattern: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For each state before and behind a block: the cost of its cheapest edits and the least string of them.

    ``pattern`` has a letter for each row: S, U, A or X (another role), in lower case if truncated; D must be deleted.
    """
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for goal in range(4):
        price = auction(pattern, goal)
        for entry in range(4):
            cost = price.get((0, entry), INF)
            if cost >= INF:
                continue
            node, letters = (0, entry), []
            while node != (len(pattern), goal):
                # Tight arcs all lead on to the goal, so the least letter is always the right one.
                for letter, cost_, *ahead in _arcs(pattern, *node):
                    if price[node] == cost_ + price.get((ahead[0], ahead[1]), INF):
                        letters.append(letter)
                        node = (ahead[0], ahead[1])
                        break
            table[entry][goal] = (cost, "".join(letters))
    return tuple(map(tuple, table))


def _chain(blocks: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """The cost of the cheapest edits over all blocks, the states around each on the least path, and the rows added at the end.

    A block has 16 costs and the 16 places of their strings among those with the same state before it. No string of a
    block is the start of another one of it, so blocks are compared one after the other.
    """
    rest = [list(c for c, _ in ENDINGS)]
    for costs, _ in reversed(blocks):
        rest.append([min(costs[4 * q + r] + rest[-1][r] for r in range(4)) for q in range(4)])
    rest.reverse()
    state, states = 0, []
    for (costs, places), here, after in zip(blocks, rest, rest[1:]):
        best = min((r for r in range(4) if costs[4 * state + r] + after[r] == here[state]), key=lambda r: places[4 * state + r])
        states.append((state, best))
        state = best
    return rest[0][0], states, ENDINGS[state][1]


# ---- the Spark job


def _keys(rows: DataFrame) -> DataFrame:
    """Rows with how many of them are alike (``n``), and whether the same role and text occur in an earlier turn."""
    alike = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    key = F.unhex(F.sha2(F.concat_ws(":", F.to_json(F.struct("conv")), F.length("role"), "role", "text"), 256))
    alike = alike.withColumn("_key", key)
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("at"))
    # Only what occurs in several turns is looked up; a pair common to many turns is spread over tasks.
    firsts = alike.groupBy("_key").agg(F.count("*").alias("_turns"), F.min(place).alias("_first")).filter("_turns > 1")
    joined = salted_join(alike, firsts.select("_key", "_first"), ["_key"], F.col("turn"), how="left")
    seen = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(place)
    return joined.select("conv", "turn", "role", "text", "n", seen.alias("seen"))


_BLOCK = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("turns", T.ArrayType(T.LongType())),
    T.StructField("edges", T.ArrayType(T.StringType())), T.StructField("costs", T.ArrayType(T.LongType())),
    T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("strings", T.ArrayType(T.StringType())),
    T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("copies", T.ArrayType(T.LongType()))])


def _block(conv: object, part: int, block: int, rows: list[dict]) -> list[dict]:
    """The two records of a block: its figures, which sort first, and its rows."""
    blank = duplicate = truncated = illegal = forced = 0
    pattern, before = [], None
    for row in rows:
        bare, n = row["text"].strip(SPACE), row["n"]
        initial = row["role"][:1]
        illegal += n - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
        before = initial
        forced += DELETE * (n - 1)
        if not bare or row["seen"]:
            blank, duplicate = blank + (not bare) * n, duplicate + bool(bare) * n
            pattern.append("D")
            continue
        duplicate += n - 1
        letter = initial.upper() if initial in ("s", "u", "a") else "X"
        if bare[-1] not in ".!?":
            truncated += 1
            letter = letter.lower()
        pattern.append(letter)
    table = options("".join(pattern))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    flat = [cell for line in table for cell in line]
    places = [p for line in table for cells in [sorted(c[1] for c in line if c)] for p in [cells.index(c[1]) if c else 4 for c in line]]
    base = {"conv": conv, "part": part, "block": block}
    return [
        {**base, "kind": 0, "counts": [blank, duplicate, truncated, illegal, forced],
         "turns": [turns[0], turns[-1], len(set(turns))] if turns else [], "edges": [rows[0]["role"][:1], rows[-1]["role"][:1]],
         "costs": [c[0] if c else INF for c in flat], "places": places},
        {**base, "kind": 1, "strings": [c[1] if c else None for c in flat], "roles": [r["role"] for r in rows],
         "texts": [r["text"] for r in rows], "copies": [r["n"] for r in rows]}]


def _blocks(schema: T.StructType):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        part, held, chars, number = TaskContext.get().partitionId(), [], 0, 0
        out: list[dict] = []

        def close() -> None:
            nonlocal held, chars, number
            if held:
                out.extend(_block(held[0]["conv"], part, number, held))
            held, chars, number = [], 0, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv"] != held[0]["conv"] or len(held) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    close()
                held.append(row)
                chars += len(row["text"])
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)
    return cut


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


class _Conversation:
    """What is known of one conversation while its records pass by in order: figures of all blocks, then rows of each."""

    def __init__(self, conv: object) -> None:
        self.conv, self.figures, self.states, self.hash = conv, [], None, hashlib.sha256()
        self.audit, self.first, self.place = [], True, 0
        self.counts, self.gaps, self.cost, self.ending = [0] * 4, 0, 0, ""

    def settle(self) -> None:
        """All figures are there: take counts over the joints of blocks too, and the states the path passes."""
        last, edge, distinct, low = None, None, 0, None
        forced = 0
        for f in self.figures:
            *counts, more = f["counts"]
            self.counts = [a + b for a, b in zip(self.counts, counts)]
            forced += more
            if edge is not None:
                self.counts[3] += edge + f["edges"][0] not in ("su", "ua", "au")
            edge = f["edges"][1]
            if f["turns"]:
                low = f["turns"][0] if low is None else low
                distinct += f["turns"][2] - (f["turns"][0] == last)
                last = f["turns"][1]
        self.gaps = last - low + 1 - distinct if low is not None else 0
        self.cost, self.states, self.ending = _chain([(f["costs"], f["places"]) for f in self.figures])
        self.cost += forced
        self.figures = []
        self.states.reverse()

    def add(self, record: dict) -> Iterator[dict]:
        """The repaired rows of the next block."""
        if self.states is None:
            self.settle()
        state, after = self.states.pop()
        letters = iter(record["strings"][4 * state + after])
        for role, text, n in zip(record["roles"], record["texts"], record["copies"]):
            while (letter := next(letters)) == "I":
                state = NEXT[state]
                yield self.row("I", ROLES[state], "")
            if letter == "D":
                self.audit.append("D")
            else:
                if letter == "R":
                    state = NEXT[state]
                    role = ROLES[state]
                else:
                    state = KEPT[role[0]][state]
                yield self.row(letter, role, text)
            self.audit.append("D" * (n - 1))
        self.state = after

    def row(self, letter: str, role: str, text: str) -> dict:
        self.audit.append(letter)
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False
        self.place += 1
        return {"conv": self.conv, "place": self.place - 1, "edit": letter, "role": role, "text": text}

    def close(self) -> Iterator[dict]:
        if self.states is None:
            self.settle()
        state = getattr(self, "state", 0)
        for letter in self.ending:
            state = NEXT[state]
            yield self.row(letter, ROLES[state], "")

    def summary(self) -> dict:
        blank, duplicate, truncated, illegal = self.counts
        return {"conv": self.conv, "gaps": self.gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated,
                "illegal": illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _records(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The records of all conversations, each in one task and in order."""
    conv = T.StructField("conv", rows.schema["conv"].dataType)
    schema = T.StructType([conv, *_BLOCK])
    # The sample for the ranges and the sort both read the table, so it is written once.
    keyed = landed(_keys(rows), "conversation-rows")
    order = ["conv", "turn", "role", "text"]
    blocks = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(schema), schema)
    if ids is not None:
        known = ids.toDF("conv").distinct().withColumns({f.name: F.lit(-1 if f.name == "kind" else None).cast(f.dataType) for f in _BLOCK})
        blocks = blocks.unionByName(known)
    return blocks.repartition("conv").sortWithinPartitions("conv", "kind", "part", "block")


def _passed(batches: Iterator[pa.RecordBatch], wanted: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    here: _Conversation | None = None
    out: list[dict] = []

    def finish() -> None:
        if here is not None:
            added = list(here.close())
            out.extend(added if wanted == "rows" else [here.summary()])

    for batch in batches:
        for record in batch.to_pylist():
            if here is None or record["conv"] != here.conv:
                finish()
                here = _Conversation(record["conv"])
            if record["kind"] == 0:
                here.figures.append(record)
            elif record["kind"] == 1:
                repaired = list(here.add(record))
                if wanted == "rows":
                    out.extend(repaired)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    finish()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of (conv, turn, role, text), and for each other id in the one column of ``ids``:
    conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role and text. No null may be in role or text (``damage`` and
    ``with_spaces`` write a space); a null conv is a conversation like others. A row's first fault counts: blank,
    duplicate (role and text occur earlier; all but one of equal rows), truncated (the last visible character is not one
    of ``. ! ?``). A role without a first character fits nowhere and has to be changed or deleted. An id without rows gets
    zeros, an empty audit and the hash of the empty string; an empty table without ids gives no rows.

    The audit and the hash of a conversation are one cell, which one task writes; it sees a hash's input as a stream and
    keeps 32 numbers for every block of 128 rows. All other work on a long conversation is spread over tasks.
    """
    fields = [T.StructField("conv", rows.schema["conv"].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = T.StructType([*fields, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _records(rows, ids).mapInArrow(lambda batches: _passed(batches, "summary", _arrow(schema)), schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv, place (0, 1, 2 ...), edit (K, R or I), role, text; see ``repair``."""
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), T.StructField("place", T.LongType()),
                           *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    return _records(rows, None).mapInArrow(lambda batches: _passed(batches, "rows", _arrow(schema)), schema)


def with_spaces(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Undamaged rows as (conv, turn, role, text), null roles and texts as one space."""
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                       F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
