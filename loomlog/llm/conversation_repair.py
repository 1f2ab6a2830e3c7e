"""Conversations brought into the form system? (user assistant)+ by the cheapest edits.

A forward Viterbi search over four states of the grammar (nothing yet, after system, after user, after assistant). Each state
carries its cheapest way so far as (cost, audit string) and a running digest of the turns it keeps; a turn moves every
state by keeping, giving another role or deleting, and its layer is closed by at most two inserted turns, as a third would
come back to a state that was there for less.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import runs_of_rows

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5  # more for a truncated turn that is not deleted
BLANK, REPEATED, CUT = 1, 2, 3
#: From each state, the state that a turn of this initial leads to, and the one role that can be given or inserted there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}
_CHUNK = 512


class Way:
    """The cheapest way into a state. Its audit string is `past` (chunks, shared with other ways) and `tail`; `rank` orders
    the pasts of the ways of a layer, which are equal or differ within their length."""

    __slots__ = ("cost", "rank", "tail", "past", "digest", "begun")

    def __init__(self, cost=0, rank=0, tail="", past=None, digest=None, begun=False):
        self.cost, self.rank, self.tail, self.past, self.digest, self.begun = cost, rank, tail, past, digest or hashlib.sha256(), begun

    def audit(self) -> str:
        parts, past = [self.tail], self.past
        while past is not None:
            past, part = past
            parts.append(part)
        return "".join(reversed(parts))


class Search:
    def __init__(self):
        self.ways: list[Way | None] = [Way(), None, None, None]
        self._close()

    def _settle(self, offers: dict, kept: dict) -> None:
        """offers: state -> the best (cost, rank, tail, way, role, text) into it. The chosen ways go on; only they are digested."""
        for state, (cost, rank, tail, way, role, text) in offers.items():
            if role is None:
                kept[state] = Way(cost, rank, tail, way.past, way.digest, way.begun)
            else:
                digest = way.digest.copy()
                digest.update(f"{chr(10) if way.begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                kept[state] = Way(cost, rank, tail, way.past, digest, True)

    def turn(self, role: str, text: str, fault: int) -> None:
        best: dict[int, tuple] = {}

        def offer(state, *x):
            if state not in best or x[:3] < best[state][:3]:
                best[state] = x

        for state, way in enumerate(self.ways):
            if way is None:
                continue
            offer(state, way.cost + DELETE, way.rank, way.tail + "D", way, None, None)
            if fault in (BLANK, REPEATED):
                continue
            extra = TRUNCATED if fault == CUT else 0
            if (after := NEXT[state].get(role[:1])) is not None:
                offer(after, way.cost + KEEP + extra, way.rank, way.tail + "K", way, role, text)
            given = GIVEN[state]
            offer(NEXT[state][given[0]], way.cost + REROLE + extra, way.rank, way.tail + "R", way, given, text)
        settled: dict[int, Way] = {}
        self._settle(best, settled)
        self.ways = [settled.get(s) for s in range(4)]
        live = [w for w in self.ways if w is not None]
        if max(len(w.tail) for w in live) > _CHUNK:
            # All ways have just used the same turns, so no audit string is the beginning of another one.
            for rank, w in enumerate(sorted(live, key=lambda w: (w.rank, w.tail))):
                w.rank, w.past, w.tail = rank, (w.past, w.tail), ""
        self._close()

    def _close(self) -> None:
        for _ in range(2):
            offers = {}
            for state, way in enumerate(self.ways):
                if way is None:
                    continue
                given = GIVEN[state]
                after, x = NEXT[state][given[0]], (way.cost + INSERT, way.rank, way.tail + "I", way, given, "")
                old = self.ways[after]
                if (old is None or x[:3] < (old.cost, old.rank, old.tail)) and (after not in offers or x[:3] < offers[after][:3]):
                    offers[after] = x
            settled: dict[int, Way] = {}
            self._settle(offers, settled)
            for state, way in settled.items():
                self.ways[state] = way

    def result(self) -> Way:
        """The best way that ends with nothing or after an assistant."""
        return min((w for w in (self.ways[0], self.ways[3]) if w is not None), key=lambda w: (w.cost, w.rank, w.tail))


class Conversation:
    """Counts and the search of one conversation, whose turns come in order."""

    def __init__(self, name):
        self.name, self.search, self.last = name, Search(), None
        self.counts = {BLANK: 0, REPEATED: 0, CUT: 0}
        self.low = self.high = None
        self.distinct = self.illegal = 0

    def add(self, number: int | None, role: str, text: str, copies: int, fault: int) -> None:
        if number is not None and number != self.high:
            self.low = number if self.low is None else self.low
            self.high, self.distinct = number, self.distinct + 1
        for _ in repeat(None, copies):
            if self.last is not None and self.last + role[:1] not in LEGAL:
                self.illegal += 1
            self.last = role[:1]
            if fault:
                self.counts[fault] += 1
            self.search.turn(role, text, fault)
            fault = fault if fault == BLANK else REPEATED

    def row(self) -> tuple:
        best = self.search.result()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.name, gaps, self.counts[BLANK], self.counts[REPEATED], self.counts[CUT], self.illegal, best.cost, best.audit(), best.digest.hexdigest())


COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _turns(conversations: DataFrame, key: str, present: str | None) -> DataFrame:
    """key, turn, role, text, copies, fault, one row for equal turns; a conversation's rows that are not present become one
    row without role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.col(present) if present else F.lit(True)
    rows = conversations.select(F.col(key).alias("key"), F.when(here, F.col("turn")).alias("turn"), F.when(here, space("role")).alias("role"), F.when(here, space("text")).alias("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    bare = F.rtrim("text", F.lit(SPACE))
    earlier = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(bare == "", BLANK).when(earlier, REPEATED).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.withColumn("fault", fault.cast("int"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "text")


def repair(conversations: DataFrame, key: str = "conv_id", present: str | None = None) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    conversations: key, turn, role, text, in order of turn (nulls first; rows of one turn by role, then text). Null roles and
    texts count as one space; rows with a null key are one conversation. Each turn's first fault counts: blank (white space
    only), duplicate (role and text occurred earlier), truncated (does not end with . ! or ?). Edits, with their letters in
    the audit string: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate turns), Insert
    an empty turn of user or assistant 5; a truncated turn that stays costs 5 more. Of equally cheap edits the ASCII-least
    audit counts. gaps: missing numbers between the least and the greatest turn. illegal: neighbours that the form forbids.
    The digest is that of the repaired `role:text`, joined by newlines. Rows whose column `present` is false are no turns,
    but their conversation has a row: zeros and the digest of nothing. An empty table gives no rows; other columns are ignored.

    Equal turns are counted before they are shuffled, and repeats are found by (key, role, text), so no task has them all.
    A digest and an audit string are one value of the whole conversation, so its turns pass one task, sorted, one at a
    time: that holds four ways, and of the audit a byte or two for each turn, but no texts, however long it is."""
    rows = _in_order(_turns(conversations, key, present))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        now, done, id_type = None, [], None
        for batch in batches:
            id_type = batch.column(0).type
            for part in runs_of_rows(batch, 3):
                for name, number, role, text, copies, fault in zip(*(part.column(k).to_pylist() for k in range(6))):
                    if now is None or now.name != name:
                        if now is not None:
                            done.append(now.row())
                        now = Conversation(name)
                    if role is not None:
                        now.add(number, role, text, copies, fault)
                if len(done) > 256:
                    yield table(done, id_type)
                    done = []
        if now is not None:
            done.append(now.row())
            yield table(done, id_type)

    def table(done, id_type):
        columns = list(zip(*done))
        types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", *[c.split()[0] for c in COLUMNS.split(", ")]])

    return rows.mapInArrow(run, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)


def repaired_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, place (from 1), edit (K, R or I), turn (null: inserted), role, text: the repaired conversations, one row per turn.
    Each conversation's audit string precedes its turns in its task, which applies it letter by letter."""
    turns = _turns(conversations, key, None).withColumn("head", F.lit(1)).drop("fault")
    audits = repair(conversations, key).select(F.col(key).alias("key"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"), F.lit(0).alias("head"))
    rows = _in_order(audits.unionByName(turns), "head")
    kind, number_kind = rows.schema["key"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    names = ["key", "place", "edit", "turn", "role", "text"]

    def run(batches):
        name, audit, at, place, state = None, "", 0, 0, 0
        for batch in batches:
            id_type, number_type = batch.column(0).type, batch.column(1).type
            for part in runs_of_rows(batch, 3):
                out = []

                def put(edit, number, role, text):
                    nonlocal place, state
                    place += 1
                    state = NEXT[state][role[:1]]
                    out.append((name, place, edit, number, role, text))

                def inserts():
                    nonlocal at
                    while audit[at : at + 1] == "I":
                        at += 1
                        put("I", None, GIVEN[state], "")

                for row_name, number, role, text, copies, head in zip(*(part.column(k).to_pylist() for k in range(6))):
                    if head == 0:
                        name, audit, at, place, state = row_name, text, 0, 0, 0
                        inserts()
                        continue
                    for _ in repeat(None, copies):
                        edit, at = audit[at], at + 1
                        if edit != "D":
                            put(edit, number, GIVEN[state] if edit == "R" else role, text)
                        inserts()
                columns = list(zip(*out)) or [[]] * 6
                types = [id_type, pa.int64(), pa.string(), number_type, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.mapInArrow(run, f"key {kind}, place long, edit string, turn {number_kind}, role string, text string").withColumnRenamed("key", key)


def damaged(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turn, role, text, here: conversations with known damage, by crc32 of `key:turn` modulo 20: 0 the turn is gone
    (here is false), 1 its text is empty, 2 its text has lost . ! and ?, 3 it is there twice, 4 its role is user. Nulls are one
    space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(key), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = conversations.select(key, "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind != 0).alias("here"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"))
    return rows.drop("__copy")
