"""Benchmark decontamination by pigeonhole edit matching.

A passage of a document that equals a test item up to k edits holds at least one of any k + 1
pieces of the item unchanged. Items are cut into k + 1 pieces; one automaton finds all exact
piece hits in a linear scan over each whole text; the text around a hit, wide enough for k
edits, is verified by Myers' bit-parallel distance, which gives the smallest number of edits
of the item against any passage ending at each position.

Test items are a stated query set. They are collected in blocks of a bounded size, each block
is one automaton that is broadcast, and documents are scanned once per block: a map over the
documents that shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, read, whole_text

EDIT_SHARE = 0.07       # edits per character of an item
LEAST_CHARS = 40        # shorter items are matched exactly, as whole words
BLOCK_CHARS = 4_000_000  # characters of test items in one automaton
NOT_WORD = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    """Lower case, every run of other characters than letters and digits one space, with a
    space at both ends."""
    return f" {NOT_WORD.sub(' ', text.lower()).strip()} "


def normal_with_positions(text: str) -> tuple[str, list[int]]:
    """The same text and, per character, where it comes from."""
    out, at = [" "], [0]
    for k, c in enumerate(text):
        for low in c.lower():
            if low.isalnum():
                out.append(low)
                at.append(k)
            elif out[-1] != " ":
                out.append(" ")
                at.append(k)
    if out[-1] != " ":
        out.append(" ")
        at.append(len(text))
    return "".join(out), at


def budget(item: str, share: float = EDIT_SHARE) -> int:
    return int(len(item) * share) if len(item) >= LEAST_CHARS else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of text nearest to item, the first such end, or None
    beyond k edits. Bit-parallel: one machine word operation set per text character."""
    m = len(item)
    masks: dict[str, int] = {}
    for j, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << j
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = None
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & full
        ph, mh = (down | ~(d0 | up)) & full, d0 & up
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        up, down = (mh << 1 & full | ~(d0 | ph)) & full, ph & d0
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE) -> None:
        import ahocorasick
        self.items = [(item_id, text, budget(text, share)) for item_id, text in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for j, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((j, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Per item the windows of text that a match around a hit lies in, merged where they overlap."""
        spans: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for j, offset in at:
                _, item, k = self.items[j]
                a = max(0, end + 1 - size - offset - k)
                b = min(len(text), end + 1 - size - offset + len(item) + k)
                spans.setdefault(j, []).append([a, b])
        out = {}
        for j, found in spans.items():
            found.sort()
            merged = [found[0]]
            for a, b in found[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out[j] = [tuple(x) for x in merged]
        return out

    def find(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """item_id, edits, start, end in the normalised text: the best match of every item."""
        out = []
        if not self.items:
            return out
        for j, windows in self.candidates(text).items():
            item_id, item, k = self.items[j]
            best = None
            for a, b in windows:
                part = text[a:b]
                at = part.find(item)
                got = (0, at + len(item)) if at >= 0 else myers(item, part, k)
                if got and (best is None or got[0] < best[0]):
                    # the start: the same scan from the end backwards
                    back = len(item) if not got[0] else myers(item[::-1], part[max(0, got[1] - len(item) - k):got[1]][::-1], k)[1]
                    best = (got[0], a + got[1] - back, a + got[1])
            if best:
                out.append((item_id, *best))
                if first_only:
                    break
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, block by block; items without letters or digits match nothing. Items
    of equal text stay apart: each is reported under its own id."""
    table = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    n = table.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n // block_chars + 1
    for b in range(n):
        part = table if n == 1 else table.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        items = [(r.item_id, normal(r.text)) for r in part.collect()]
        yield sorted(((i, t) for i, t in items if t.strip()), key=str)


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, first, last: every test item that a whole text holds up to the
    error budget, with the span of its best match in code points of the text (end exclusive).

    Null and empty texts hold nothing; repeated rows are reported as often as they occur;
    null ids pass through; an empty benchmark finds nothing.
    """
    taken, out = docs.select(F.col(id_col).cast("long"), whole_text(text_col)), None
    for items in item_blocks(benchmark, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for batch in batches:
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                    found = matcher.find(normal(text))
                    if found:
                        _, at = normal_with_positions(text)
                        rows += [(doc_id, item, edits, at[min(a + 1, len(at) - 1)] if a < len(at) else len(text), at[b - 2] + 1) for item, edits, a, b in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), HITS)], schema=HITS)
        hits = taken.mapInArrow(run, "doc_id long, item_id long, edits int, first int, last int")
        out = hits if out is None else out.unionByName(hits)
    return out


def _free_of(shared, share: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, share)
        for texts in batches:
            yield texts.map(lambda t: not matcher.find(normal(t), first_only=True)).astype(bool)
    return clean


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents that hold no test item, with all their columns."""
    for items in item_blocks(benchmark, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        docs = docs.where(_free_of(shared, share)(whole_text()))
    return docs


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the item and where it stands."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
