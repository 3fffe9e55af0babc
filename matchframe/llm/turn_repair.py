"""Conversation structure repair by Wagner-Fischer alignment with alternating targets.

A sound conversation's role initials spell `(s?(ua)+)?`. The turns are aligned with the target
strings of that grammar of every feasible length; a Ukkonen band around the diagonal, as wide as
the cost of an incumbent repair allows, holds every cell that a cheaper alignment can visit. All
lengths share their endings, so one banded matrix per last symbol gives the cost of each. The
audits of the cheapest lengths are traced and the least in ASCII order is taken.

A long conversation is cut into blocks of turns. A block is aligned with the targets that lead
from each grammar state to each other one; costs and the order of the audits are folded over the
blocks of a conversation, and each block is traced between the states that the fold chose. An
inserted turn stands before a turn of the same block or at the end of the conversation, so two
audits of a block never are prefixes of each other and the fold gives the least audit overall.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, query, read

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
BLOCK = 512            # turns of a block
# grammar states: nothing yet, after s, after u, after a
START, S, U, A = range(4)
STATES = (START, S, U, A)
TAIL = {START: "", A: "", U: "I", S: "II"}  # turns to insert after the last one
FAR = 1 << 30
OTHER = {"u": "a", "a": "u"}
LEGAL = {"su", "ua", "au"}
INK = re.compile(r"[^\x20\x09-\x0D]")
MEMO_ENTRIES, MEMO_TURNS = 50_000, 64
# faults, and the letter of a turn for the alignment: lower case, upper case if it is truncated,
# x if it has to go
SOUND, BLANK, DUPLICATE, CUT = "0123"


def letters(codes: str) -> str:
    """One letter a turn from its two-letter code (role initial, fault)."""
    out = []
    for initial, fault in zip(codes[::2], codes[1::2]):
        out.append("x" if fault in (BLANK, DUPLICATE) else initial.upper() if fault == CUT else initial)
    return "".join(out)


def _greedy(word: str, state: int) -> int:
    """Cost of a repair that keeps what fits, inserts before a turn that comes too soon and gives
    other turns the expected role."""
    cost, expect = 0, "a" if state == U else "u"
    for c in word:
        if c == "x":
            cost += DELETE
            continue
        cost += TRUNCATED * c.isupper()
        low = c.lower()
        if low == expect:
            expect = OTHER[expect]
        elif low in OTHER:
            cost += INSERT  # the missing turn, then this one
        else:
            cost += REROLE
            expect = OTHER[expect]
    return cost


class Matrix:
    """Costs of aligning the turns from i on with the last r symbols of an alternating string
    that ends in `end`; nothing is inserted after the last turn."""

    def __init__(self, word: str, end: str, incumbent: int) -> None:
        self.word, self.end = word, end
        n = len(word)
        slack = max(0, incumbent - DELETE * word.count("x"))
        below, above = slack // DELETE, slack // INSERT
        width = n - word.count("x") + above + 2
        self.first = np.zeros(n + 1, int)
        self.rows: list[np.ndarray] = [np.zeros(0, int)] * (n + 1)
        left = 0  # turns from i on that may stay
        steps = np.arange(width) * INSERT
        symbols = np.array([0, *[1 if r % 2 else 2 for r in range(1, width)]])  # 1: `end`, 2: the other
        self.rows[n] = np.where(np.arange(min(width, above + 1)) == 0, 0, FAR)
        for i in range(n - 1, -1, -1):
            c, old, start = word[i], self.rows[i + 1], self.first[i + 1]
            left += c != "x"
            lo, hi = max(0, left - below), min(width, left + above + 1)
            row = np.full(hi - lo, FAR)
            a, b = max(lo, start), min(hi, start + len(old))
            row[a - lo:b - lo] = old[a - start:b - start] + DELETE
            if c != "x":
                a, b = max(lo, start + 1), min(hi, start + len(old) + 1)
                same = 1 if c.lower() == end else 2 if c.lower() == OTHER[end] else 0
                stay = old[a - 1 - start:b - 1 - start] + np.where(symbols[a:b] == same, KEEP, REROLE) + TRUNCATED * c.isupper()
                row[a - lo:b - lo] = np.minimum(row[a - lo:b - lo], stay)
            k = steps[lo:hi]
            self.rows[i], self.first[i] = np.minimum(np.minimum.accumulate(row - k) + k, FAR), lo

    def cost(self, i: int, r: int) -> int:
        at = r - self.first[i]
        return int(self.rows[i][at]) if 0 <= at < len(self.rows[i]) else FAR

    def symbol(self, r: int) -> str:
        return self.end if r % 2 else OTHER[self.end]

    def lengths(self, i: int, head: str) -> Iterator[tuple[int, int]]:
        """Length and cost of the targets that begin with `head`."""
        for r in range(1 if self.end == head else 2, self.first[i] + len(self.rows[i]), 2):
            yield r, self.cost(i, r)

    def trace(self, i: int, r: int) -> str:
        """The least audit in ASCII order among the cheapest alignments."""
        out, word, n = [], self.word, len(self.word)
        while i < n:
            here, c = self.cost(i, r), word[i]
            if self.cost(i + 1, r) + DELETE == here:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == here:
                out.append("I")
                r -= 1
            else:
                out.append("K" if c.lower() == self.symbol(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(word: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Per pair of grammar states before and after a block: cost and audit of its best repair."""
    n, gone = len(word), DELETE * len(word)
    found: dict[tuple[int, int], tuple[int, str]] = {(x, x): (gone, "D" * n) for x in STATES}
    if not n:
        return found
    # a last turn can be made to end in either symbol by an insertion and another role
    incumbent = max(_greedy(word, U), _greedy(word, A)) + INSERT + REROLE
    heads = [k for k, c in enumerate(word) if c in "sS" and DELETE * k <= incumbent + gone]
    alone = [(gone - DELETE + TRUNCATED * (word[k] == "S"), "D" * k + "K" + "D" * (n - 1 - k)) for k in heads]
    if alone:
        found[START, S] = min(alone)
    for y, end in ((U, "u"), (A, "a")):
        m = Matrix(word, end, incumbent)
        for x in STATES:
            head = "a" if x == U else "u"
            options = [(cost, 0, r) for r, cost in m.lengths(0, head) if cost < FAR]
            if x == START:  # s first: what stands before it goes
                options += [(DELETE * k + TRUNCATED * (word[k] == "S") + cost, k + 1, r) for k in heads for r, cost in m.lengths(k + 1, "u") if cost < FAR]
            if not options:
                continue
            least = min(o[0] for o in options)
            audits = ["D" * (i - 1) + "K" + m.trace(i, r) if i else m.trace(0, r) for cost, i, r in options if cost == least]
            got = (least, min(audits))
            found[x, y] = min(got, found[x, y]) if (x, y) in found else got
    return found


_memo: dict[str, dict] = {}


def aligned(word: str) -> dict[tuple[int, int], tuple[int, str]]:
    """align(), remembered by a worker for short blocks: most conversations look like others."""
    got = _memo.get(word)
    if got is None:
        got = align(word)
        if len(word) <= MEMO_TURNS:
            if len(_memo) >= MEMO_ENTRIES:
                _memo.clear()
            _memo[word] = got
    return got


def order_of(found: dict[tuple[int, int], tuple[int, str]]) -> tuple[list[int], list[int]]:
    """Cost of every pair of states (-1: none) and the place of its audit among those from the same state."""
    costs, places = [-1] * 16, [0] * 16
    for x in STATES:
        audits = sorted(found[x, y][1] for y in STATES if (x, y) in found)
        for y in STATES:
            if (x, y) in found:
                costs[4 * x + y], places[4 * x + y] = found[x, y][0], audits.index(found[x, y][1])
    return costs, places


def fold(blocks: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost of a conversation and the states before and after each of its blocks."""
    rest = [{y: INSERT * len(TAIL[y]) for y in STATES}]
    for costs, _ in reversed(blocks):
        after = rest[-1]
        rest.append({x: min((costs[4 * x + y] + after[y] for y in STATES if costs[4 * x + y] >= 0), default=FAR) for x in STATES})
    rest.reverse()
    x, path = START, []
    for k, (costs, places) in enumerate(blocks):
        best = [(places[4 * x + y], y) for y in STATES if costs[4 * x + y] >= 0 and costs[4 * x + y] + rest[k + 1][y] == rest[k][x]]
        y = min(best)[1]
        path.append((x, y))
        x = y
    return rest[0][START], path


# ---- the table

def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: planted faults by crc32 of `conv_id:turn` modulo 20 -
    0 drops a turn, 1 empties its text, 2 takes out its `[.!?]`, 3 repeats it, 4 makes its role
    user. Nulls count as one space each."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


TAGGED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("pos", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("codes", pa.string())])
TAGGED_DDL = "conv_id long, block long, pos int, role string, text string, codes string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ordered rows (conv_id, turn, role, digest, mark, text, copies): turns with their block
    and place; the last turn of a block carries the codes of all. A mark says that the turns of
    its key were said before."""
    part = TaskContext.get().partitionId() << 32
    block, key, seen, codes = -1, None, False, []
    held: list[tuple] = []  # the last turn, until it is known whether the block goes on

    def close(row):
        return (*row[:5], "".join(codes))
    for batch in batches:
        out = []
        for conv, turn, role, digest, mark, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if mark == 0:
                key, seen = (conv, turn, role, digest), True
                continue
            if key != (conv, turn, role, digest):
                key, seen = (conv, turn, role, digest), False
            for _ in range(copies):
                if not held or held[0][0] != conv or len(codes) == BLOCK:
                    if held:
                        out.append(close(held.pop()))
                    block, codes = block + 1, []
                elif held:
                    out.append((*held.pop()[:5], None))
                said = INK.findall(text[-64:]) or INK.findall(text)
                fault = BLANK if not said else DUPLICATE if seen else SOUND if said[-1] in ".!?" else CUT
                codes.append((role[:1] if role[:1] in ("s", "u", "a") else "o") + fault)
                held.append((conv, part + block, len(codes) - 1, role, text))
                seen = True
        if out:
            yield _batch(out, TAGGED)
    if held:
        yield _batch([close(held.pop())], TAGGED)


def tag(damaged: DataFrame) -> DataFrame:
    """The turns after damage in order, cut into blocks, with their faults (see _cut).

    Texts are sorted once, in ranges of conversation and turn: a long conversation takes many
    tasks. Turns whose role and text stand at an earlier turn are found on digests alone and
    reach the sorted rows as marks. Turns of the same number are ordered by role and digest.
    """
    keyed = damaged.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    said = keyed.groupBy("conv_id", "turn", "role", "digest").agg(F.lit(0).alias("mark"))
    first = said.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last")).where("first <> last")
    f = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marks = said.join(f, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    marks = marks.where(~F.col("turn").eqNullSafe(F.col("first.turn"))).select("conv_id", "turn", "role", "digest", "mark", F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    rows = keyed.select("conv_id", "turn", "role", "digest", F.lit(1).alias("mark"), "text", "copies").unionByName(marks)
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest", "mark")
    return ordered.mapInArrow(_cut, TAGGED_DDL)


SUMMARY = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("blank", pa.int64()),
                     ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("ends", pa.string())])
SUMMARY_DDL = "conv_id long, block long, costs array<int>, places array<int>, blank long, duplicate long, truncated long, illegal long, ends string"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, block, codes in zip(*(c.to_pylist() for c in batch.columns)):
            initials, faults = codes[::2], codes[1::2]
            illegal = sum(initials[k:k + 2] not in LEGAL for k in range(len(initials) - 1))
            rows.append((conv, block, *order_of(aligned(letters(codes))), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, initials[0] + initials[-1]))
        if rows:
            yield _batch(rows, SUMMARY)


FOLDED = pa.schema([("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                    ("blocks", pa.list_(pa.int64())), ("steps", pa.list_(pa.int32()))])
FOLDED_DDL = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, blocks array<long>, steps array<int>"


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, blocks, blank, duplicate, truncated, illegal in zip(*(c.to_pylist() for c in batch.columns)):
            cost, path = fold([(b["costs"], b["places"]) for b in blocks])
            borders = sum(a["ends"][1] + b["ends"][0] not in LEGAL for a, b in zip(blocks, blocks[1:]))
            rows.append((conv, blank, duplicate, truncated, illegal + borders, cost, [b["block"] for b in blocks], [4 * x + y for x, y in path]))
        if rows:
            yield _batch(rows, FOLDED)


AUDITS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("audit", pa.string())])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, block, codes, step, last in zip(*(c.to_pylist() for c in batch.columns)):
            audit = aligned(letters(codes))[divmod(step, 4)][1]
            rows.append((conv, block, audit + TAIL[step % 4] if last else audit))
        if rows:
            yield _batch(rows, AUDITS)


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ordered rows (conv_id, block, pos, role, text), the audit of a block before its turns
    (pos -1): the repaired turns in order."""
    now, state, audit, at, place = (), START, "", 0, 0

    def insert():
        nonlocal state, at, place
        state, at, place = A if state == U else U, at + 1, place + 1
        return (now[0], place, "assistant" if state == A else "user", "")
    for batch in batches:
        out = []
        for conv, _, pos, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if pos < 0:
                while at < len(audit):  # what the conversation before ends with
                    out.append(insert())
                if now != (conv,):
                    now, state, place = (conv,), START, 0
                audit, at = text, 0
                continue
            while audit[at] == "I":
                out.append(insert())
            op, at = audit[at], at + 1
            if op == "D":
                continue
            place += 1
            if op == "R":
                role = "assistant" if state == U else "user"
            state = {"s": S, "u": U, "a": A}[role[0]]
            out.append((conv, place, role, text))
        if out:
            yield _batch(out, REPAIRED)
    out = []
    while at < len(audit):
        out.append(insert())
    if out:
        yield _batch(out, REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, digest = (), None
    for batch in _apply(batches):
        out = []
        for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (conv,):
                if digest:
                    out.append((*now, digest.hexdigest()))
                now, digest = (conv,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if out:
            yield _batch(out, schema)
    if digest:
        yield _batch([(*now, digest.hexdigest())], schema)


class Repair:
    """A table of turns (conv_id, turn, role, text, copies) aligned with the grammar: `report()`
    has one row per conversation, `turns()` the repaired turns."""

    def __init__(self, damaged: DataFrame) -> None:
        self.damaged = damaged
        self.tagged = materialize(tag(damaged))
        blocks = self.tagged.where("codes IS NOT NULL").select("conv_id", "block", "codes")
        summaries = blocks.mapInArrow(_summaries, SUMMARY_DDL)
        listed = summaries.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "places", "ends"))).alias("blocks"),
                                                  *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
        self.folded = materialize(listed.mapInArrow(_folds, FOLDED_DDL))
        step = self.folded.select(F.posexplode(F.arrays_zip("blocks", "steps")).alias("k", "z"), F.size("steps").alias("n"))
        step = step.select(F.col("z.blocks").alias("block"), F.col("z.steps").alias("step"), (F.col("k") + 1 == F.col("n")).alias("last"))
        self.audits = materialize(blocks.join(step, "block").select("conv_id", "block", "codes", "step", "last").mapInArrow(_audits, "conv_id long, block long, audit string"))

    def _ordered(self) -> DataFrame:
        """Turns behind the audit of their block: the repaired text of a conversation is one
        sequence, so its turns stream through one task."""
        audits = self.audits.select("conv_id", "block", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
        rows = self.tagged.select("conv_id", "block", "pos", "role", "text").unionByName(audits)
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")

    def turns(self) -> DataFrame:
        """conv_id, place, role, text of the repaired conversations."""
        return self._ordered().mapInArrow(_apply, "conv_id long, place long, role string, text string")

    def digests(self) -> DataFrame:
        """SHA-256 of the `role:text` lines of every conversation that keeps a turn."""
        return self._ordered().mapInArrow(_digests, "conv_id long, repaired_sha256 string")

    def report(self) -> DataFrame:
        """conv_id, gaps, faults, cost, audit and digest per conversation with turns."""
        numbers = self.damaged.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
        audit = self.audits.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda a: a["audit"]), "").alias("audit"))
        out = self.folded.drop("steps", "blocks")
        for k, part in enumerate((numbers, audit, self.digests())):
            out = out.join(part.withColumnRenamed("conv_id", f"c{k}"), F.col("conv_id").eqNullSafe(F.col(f"c{k}")), "left").drop(f"c{k}")
        return out


def repair_report(turns: DataFrame) -> DataFrame:
    """Damage, then repair, every conversation of a table (conv_id, turn, role, text).

    Null texts, roles and numbers count as one space where they are written out; null turn
    numbers come first and leave no gap; null conversation ids are one conversation. Turns of the
    same number are ordered by role and text digest. Empty texts are blank, a repeated row is a
    duplicate. A conversation without turns after damage has zeros, an empty audit and the digest
    of the empty text; other columns of the table are ignored. A text of any length is one row.
    """
    table = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    report = Repair(damage(table)).report().withColumnRenamed("conv_id", "c")
    every = table.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


@query("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    """Every conversation, damaged and repaired."""
    return repair_report(read(spark, sf_dir, "conversations"))
