"""Repair of damaged conversations by cheapest edits, found by lazy weighted determinisation.

A sound conversation's role initials are nothing, or user and assistant in turns after at most one system row: ``(s?(ua)+)?``.  A row is kept,
given another role, or deleted, and empty rows are inserted, each at a cost.  The pattern has four states, so a prefix of rows is known by the
least costs with which each state is reached.  Such vectors, less their least cost, are few: they become the states of a deterministic automaton over the
kinds of rows, made when first met and cached in a transition table.  A scan of the table gives the cost; tracing the arcs backward that are tight
(on a cheapest path) gives the pattern states that cheapest edits pass through, and among these the edits are read off from the first row on, the ASCII-least first.

Rows are sorted by range of (conversation, turn, role, start of the text), so that a conversation of any length is dealt over as many tasks as its rows need.
Conversations within a range are repaired where they are.  Those that touch an end of a range, or are long, are deferred: each range's part of them
becomes one byte a row, as long as its part of the audit, and meets the others' by conversation; the edits go back to the rows by place.
Only the digest of a conversation's whole text, which is one after the other by its nature, reads a deferred conversation's sorted rows in one task, a batch at a time.

Defined results: null roles and texts are one space, null turns come first and count for no gap, a null conv_id is a conversation of its own; rows that repeat a
turn are ordered by role, then text; repeated rows are duplicates; a role counts by its first letter, an empty one is none of the pattern's; rows marked ``gone`` only keep their
conversation's place, one of only such rows has zeros, an empty audit and the digest of the empty string; columns beside those named aren't read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from playlake.llm.scratch import Scope, materialize
from playlake.llm.worker import bound_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
#: Kinds of rows: four times the initial, plus the fault.
INITIALS, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row; the first and the last may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
ROLE = {USER: "user", ASSISTANT: "assistant"}
INSERTS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Text of a conversation from which its rows aren't held together.
LONG = 8 << 20


class Automaton:
    """The determinised repair; all that it finds out is remembered by number."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.next: dict[tuple[int, int], tuple[int, int]] = {}
        self.tight: dict[tuple[int, int, int], int] = {}
        self.steps: dict[tuple[int, int, int, int], tuple[str, tuple[str, ...], str | None, int]] = {}
        self.start, _ = self._state([0, NEVER, NEVER, NEVER])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The number of a vector's state, and what was taken off."""
        v = list(costs)
        v[USER] = min(v[USER], v[START] + INSERT, v[SYSTEM] + INSERT, v[ASSISTANT] + INSERT)
        v[ASSISTANT] = min(v[ASSISTANT], v[USER] + INSERT)
        # What an assistant's state can do for less is on no cheapest path; without it the vectors wouldn't be finite in number.
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = NEVER
        if v[START] > v[ASSISTANT] + DELETE:
            v[START] = NEVER
        least = min(v)
        key = tuple(c - least if c < NEVER else NEVER for c in v)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    @staticmethod
    def arcs(kind: int) -> Iterator[tuple[str, int, int, int]]:
        """What may be done with a row of this kind: edit, state before, state after, cost; by the edits' letters."""
        initial, fault = divmod(kind, 4)
        yield from (("D", q, q, DELETE) for q in range(4))
        if fault < 2:
            extra = TRUNCATED * fault
            if initial < 3:
                yield from (("K", q, to, extra) for q, to in (((START, SYSTEM),), ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), ((USER, ASSISTANT),))[initial])
            yield from (("R", q, to, REROLE + extra) for q, to in INSERTS.items())

    def move(self, state: int, kind: int) -> tuple[int, int]:
        """The state after a row, and the cost."""
        found = self.next.get((state, kind))
        if found is None:
            v, after = self.vectors[state], [NEVER] * 4
            for _, q, to, cost in self.arcs(kind):
                if v[q] < NEVER:
                    after[to] = min(after[to], v[q] + cost)
            found = self.next[state, kind] = self._state(after)
        return found

    def _inserted(self, state: int, mask: int) -> int:
        """The pattern states that are on cheapest paths, with those from which an insertion leads there."""
        v = self.vectors[state]
        for _ in range(2):
            for q, to in INSERTS.items():
                if mask >> to & 1 and v[q] < NEVER and v[q] + INSERT == v[to]:
                    mask |= 1 << q
        return mask

    def back(self, state: int, kind: int, mask: int) -> int:
        """The pattern states before a row that are on cheapest paths, given those after it."""
        found = self.tight.get((state, kind, mask))
        if found is None:
            after, off = self.move(state, kind)
            v, w, found = self.vectors[state], self.vectors[after], 0
            for _, q, to, cost in self.arcs(kind):
                if mask >> to & 1 and v[q] < NEVER and v[q] + cost == w[to] + off:
                    found |= 1 << q
            found = self.tight[state, kind, mask] = self._inserted(state, found)
        return found

    def step(self, state: int, kind: int, mask: int, q: int) -> tuple[str, tuple[str, ...], str | None, int]:
        """The ASCII-least cheapest edits up to a row: their letters, roles inserted before it, the row's role (empty: its own; none: deleted), and the pattern state after it."""
        found = self.steps.get((state, kind, mask, q))
        if found is None:
            after, off = self.move(state, kind)
            v, w, before = self.vectors[state], self.vectors[after], self.back(state, kind, mask)
            letters, roles, at = "", [], q
            while True:
                tight = {e: to for e, p, to, cost in self.arcs(kind) if p == at and mask >> to & 1 and v[p] + cost == w[to] + off}
                to = INSERTS[at]
                if "D" not in tight and before >> to & 1 and v[at] + INSERT == v[to]:
                    letters, at = letters + "I", to
                    roles.append(ROLE[to])
                    continue
                edit = min(tight)
                found = letters + edit, tuple(roles), {"D": None, "K": "", "R": ROLE.get(tight[edit])}[edit], tight[edit]
                break
            self.steps[state, kind, mask, q] = found
        return found

    def repair(self, kinds: bytes) -> tuple[int, str, list[tuple[tuple[str, ...], str | None]], tuple[str, ...]]:
        """Cost and audit of a conversation's rows; for each row the roles inserted before it and its own; the roles inserted at the end."""
        state, cost, states = self.start, 0, []
        for kind in kinds:
            states.append(state)
            state, off = self.move(state, kind)
            cost += off
        v = self.vectors[state]
        least = min(v[START], v[ASSISTANT])
        ends = [q for q in (START, ASSISTANT) if v[q] == least]
        mask = self._inserted(state, sum(1 << q for q in ends))
        final, masks = mask, bytearray(len(kinds))  # of the states after each row
        for i in range(len(kinds) - 1, -1, -1):
            masks[i] = mask
            mask = self.back(states[i], kinds[i], mask)
        q, letters, rows, tail = START, [], [], []
        for s, kind, m in zip(states, kinds, masks, strict=True):
            edits, roles, role, q = self.step(s, kind, m, q)
            letters.append(edits)
            rows.append((roles, role))
        while q not in ends:
            q = INSERTS[q]
            if not final >> q & 1:
                raise AssertionError("no cheapest path")
            letters.append("I")
            tail.append(ROLE[q])
        return cost + least, "".join(letters), rows, tuple(tail)


def kind_of(role: str, text: str, seen: bool) -> int:
    """A row's kind by its role's initial and its first fault."""
    last = text.rstrip(SPACES)[-1:]
    fault = 2 if not last else 3 if seen else 0 if last in ".!?" else 1
    initial = INITIALS.find(role[0]) if role else -1
    return 4 * (initial if initial >= 0 else 3) + fault


def counts(kinds: bytes) -> dict[str, int]:
    """Faults, and adjacent role initials that aren't system-user, user-assistant or assistant-user."""
    k = np.frombuffer(kinds, np.uint8)
    initial = k >> 2
    first, second = initial[:-1], initial[1:]
    legal = ((first == 0) & (second == 1)) | ((first == 1) & (second == 2)) | ((first == 2) & (second == 1))
    n = np.bincount(k & 3, minlength=4)
    return {"blank": int(n[2]), "duplicate": int(n[3]), "truncated": int(n[1]), "illegal": int((~legal).sum())}


class _Part:
    """What is known of a conversation's rows within a range."""

    def __init__(self):
        self.kinds, self.seen, self.turns, self.lo, self.hi = bytearray(), set(), 0, None, None
        self.rows: list[tuple] = []
        self.size, self.sent = 0, 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        self.kinds.append(kind_of(role, text, digest in self.seen))
        self.seen.add(digest)
        if turn is not None and turn != self.hi:
            self.turns, self.hi = self.turns + 1, turn
            self.lo = turn if self.lo is None else self.lo
        self.rows.append((role, text, digest))
        self.size += len(role) + len(text)


_RESULT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}
#: Four sorts of rows in one table: results, rows of repaired conversations, parts of deferred conversations, and their rows.
_SORTS = pa.schema([("sort", pa.string()), ("conv_id", pa.int64()), *_RESULT.items(), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
                    ("digest", pa.binary()), ("seen", pa.bool_()), ("kinds", pa.binary()), ("turns", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
_SORTS_DDL = ("sort string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, part int, place long, edit string, role string, text string, "
              "digest binary, seen boolean, kinds binary, turns long, lo long, hi long")


def edited(rows: list[tuple], steps: list[tuple[tuple[str, ...], str | None]], tail: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """The repaired rows: edit, role, text."""
    for (role, text, *_), (before, own) in zip(rows, steps, strict=True):
        yield from (("I", r, "") for r in before)
        if own is not None:
            yield ("R", own, text) if own else ("K", role, text)
    yield from (("I", r, "") for r in tail)


def _repairing(with_rows: bool, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, number = Automaton(), TaskContext.get().partitionId()
        out: list[dict] = []
        held = 0

        def deferred_rows(conv, part: _Part) -> None:
            nonlocal held
            for k, (role, text, digest) in enumerate(part.rows, part.sent):
                out.append({"sort": "deferred", "conv_id": conv, "part": number, "place": k, "role": role, "text": text, "digest": digest, "seen": part.kinds[k] & 3 >= 2})
            held += part.size
            part.sent, part.rows, part.size = part.sent + len(part.rows), [], 0

        def close(conv, part: _Part, whole: bool) -> None:
            nonlocal held
            if not whole:
                deferred_rows(conv, part)
                out.append({"sort": "part", "conv_id": conv, "part": number, "kinds": bytes(part.kinds), "turns": part.turns, "lo": part.lo, "hi": part.hi})
                return
            cost, audit, steps, tail = machine.repair(part.kinds)
            lines = list(edited(part.rows, steps, tail))
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest()
            gaps = part.hi - part.lo + 1 - part.turns if part.turns else 0
            out.append({"sort": "result", "conv_id": conv, "gaps": gaps, **counts(part.kinds), "cost": cost, "audit": audit, "repaired_sha256": digest})
            if with_rows:
                out.extend({"sort": "row", "conv_id": conv, "part": number, "place": k, "edit": edit, "role": role, "text": text} for k, (edit, role, text) in enumerate(lines))
            held += part.size

        conv, part, first = None, None, True
        for batch in batches:
            for c, turn, role, text, gone in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part is None or c != conv:
                    if part is not None:
                        close(conv, part, not first and not part.sent)
                        first = False
                    conv, part = c, _Part()
                if not gone:
                    part.add(turn, role, text)
                    if part.size > long or (part.size > 1 << 20 and (first or part.sent)):
                        deferred_rows(conv, part)
                if held > 1 << 21 or len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, _SORTS)
                    out, held = [], 0
        if part is not None:
            close(conv, part, False)
        if out:
            yield pa.RecordBatch.from_pylist(out, _SORTS)

    return run


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deferred conversations, each with its parts: the result, and for each part the edits of its rows."""
    machine = Automaton()
    step = pa.struct([("before", pa.list_(pa.string())), ("own", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), *_RESULT.items(), ("part", pa.int32()), ("steps", pa.list_(step))])
    for batch in batches:
        for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            kinds, turns, hi, lo = bytearray(), 0, None, None
            for p in parts:
                own = bytearray(p["kinds"])
                for place in p["late"] or []:
                    own[place] = own[place] | 3
                kinds += own
                if p["turns"]:
                    turns += p["turns"] - (hi is not None and p["lo"] == hi)
                    lo, hi = (p["lo"] if lo is None else lo), p["hi"]
            cost, audit, steps, tail = machine.repair(kinds)
            out = [{"conv_id": conv, "gaps": hi - lo + 1 - turns if turns else 0, **counts(kinds), "cost": cost, "audit": audit}]
            at = 0
            for p in parts:
                n = len(p["kinds"])
                out.append({"conv_id": conv, "part": p["part"], "steps": [{"before": list(b), "own": o} for b, o in steps[at : at + n]]})
                at += n
            if tail:  # a place after the last part's rows, where nothing is kept
                out[-1]["steps"].append({"before": list(tail), "own": None})
            yield pa.RecordBatch.from_pylist(out, schema)


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conversations: the digest of each."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    key, digest = None, None
    for batch in batches:
        done = []
        for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append({"key": key, "repaired_sha256": digest.hexdigest()})
                key, digest = k, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "repaired_sha256": digest.hexdigest()}], schema)


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit("null"))


def damaged(conversations: DataFrame) -> DataFrame:
    """A fixed share of damaged rows, by checksum of conversation and turn: conv_id, turn, role, text, and ``gone`` for rows that are dropped."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    sort = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"), sort.alias("sort"))
    role = F.when(F.col("sort") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("sort") == 1, "").when(F.col("sort") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), F.when(F.col("sort") != 0, text).otherwise("").alias("text"), (F.col("sort") == 0).alias("gone"), "sort")
    return rows.withColumn("copy", F.explode(F.when(F.col("sort") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "sort")


def _repaired(rows: DataFrame, with_rows: bool, long: int) -> tuple[DataFrame, DataFrame | None]:
    spark = rows.sparkSession
    bound_batches(spark)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role"), spaced("text"), gone.alias("gone"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    with Scope(spark) as scope:
        table = scope.keep(materialize(ranged.mapInArrow(_repairing(with_rows, long), _SORTS_DDL), "repaired"))
        late = table.filter("sort = 'deferred' and not seen").select("conv_id", "digest", "part", "place")
        # Blank rows stay blank.  Each part has any other text once at most here, so a group has no more rows than there are ranges.
        late = late.withColumn("turn_of", F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("part"))).filter("turn_of > 1")
        late = late.groupBy(_key(F.col("conv_id")).alias("key"), "part").agg(F.collect_list("place").alias("late"))
        parts = table.filter("sort = 'part'").select(_key(F.col("conv_id")).alias("key"), "conv_id", "part", "kinds", "turns", "lo", "hi").join(late, ["key", "part"], "left")
        parts = parts.groupBy("key", "conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "kinds", "turns", "lo", "hi", "late"))).alias("parts"))
        results = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _RESULT)
        joined = materialize(parts.select("conv_id", "parts").mapInArrow(_joining, f"conv_id long, {results}, part int, steps array<struct<before: array<string>, own: string>>"), "joined")
        steps = joined.filter("part is not null").select(_key(F.col("conv_id")).alias("key"), "part", F.posexplode("steps").alias("place", "step"))
        held = table.filter("sort = 'deferred'").select(_key(F.col("conv_id")).alias("key"), "part", "place", "role", "text")
        both = steps.withColumn("place", F.col("place").cast("long")).join(held, ["key", "part", "place"], "left")
        line = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
        inserted = F.transform("step.before", lambda r: line(F.lit("I"), r, F.lit("")))
        own = F.when(F.col("step.own").isNull(), F.array().cast("array<struct<edit: string, role: string, text: string>>")).when(F.col("step.own") == "", F.array(line(F.lit("K"), F.col("role"), F.col("text"))))
        lines = both.select("key", "part", "place", F.posexplode(F.concat(inserted, own.otherwise(F.array(line(F.lit("R"), F.col("step.own"), F.col("text")))))).alias("within", "line"))
        lines = scope.keep(materialize(lines.select("key", "part", "place", "within", "line.*"), "lines"))
        in_order = lines.select("key", "part", "place", "within", F.concat("role", F.lit(":"), "text").alias("line")).repartition("key").sortWithinPartitions("key", "part", "place", "within")
        digests = in_order.select("key", "line").mapInArrow(_digesting, "key string, repaired_sha256 string")
        late_results = joined.filter("part is null").select(_key(F.col("conv_id")).alias("key"), "conv_id", *_RESULT).join(digests, "key", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
        late_results = scope.keep(materialize(late_results.drop("key"), "late_results"))
        found = table.filter("sort = 'result'").select("conv_id", *_RESULT, "repaired_sha256").unionByName(late_results)
        if not with_rows:
            return found, None
        place = lambda *c: F.struct(*(F.col(x).cast("long").alias(n) for x, n in zip(c, ("part", "place", "within"), strict=True))).alias("place")
        whole = table.filter("sort = 'row'").withColumn("within", F.lit(0)).select("conv_id", place("part", "place", "within"), "edit", "role", "text")
        split = lines.select(F.when(F.col("key") != "null", F.col("key")).cast("long").alias("conv_id"), place("part", "place", "within"), "edit", "role", "text")
        return found, whole.unionByName(split)


def repair(rows: DataFrame, long: int = LONG) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _repaired(rows, False, long)[0]


def repaired_rows(rows: DataFrame, long: int = LONG) -> DataFrame:
    """The rows of all repaired conversations: conv_id, place (ordered within a conversation), edit, role, text."""
    return _repaired(rows, True, long)[1]
