"""Spelling variants by a dictionary of trie-node pairs.

Every prefix of a word is a node of a trie, every suffix a node of the trie of reversed words, and
nodes have numbers. Cutting a word before position i gives the pair (prefix node, suffix node) of
its two parts; leaving position i out gives the pair of what stands around it. Two words of one
length that differ in one code point share a pair around that position, and a word with one code
point left out has a pair that cuts the shorter word. Equal integer pairs are exact neighbours:
no text is compared, and a pair has at most one word per letter of the alphabet.

The tries are numbered without being held anywhere. Words are sorted in ranges; within a task a
word shares the nodes up to its common prefix with the word before and opens new ones behind it.
Nodes that lie on the last word of a range may go on in later ranges; they are numbered beforehand
from the last words of all ranges, one per task. A path is stored as runs of consecutive numbers,
so a word of any length takes little more than one run.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, query, read, whole_text

LEAST_LENGTH, LEAST_COUNT, DOMINANCE, DAMAGE = 7, 2, 10, 31
RUN = re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HELD_WORDS = 400_000     # distinct words a task counts before it sends them on
HELD_BYTES = 32 << 20
PAIR_ROWS = 1 << 16      # rows of an output batch
BORDER = 1 << 62         # numbers of nodes on the last words of ranges start here
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


# ---- words and their counts

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n from rows (doc_id, text); a run whose checksum with the id is divisible by 31
    loses a letter. Runs are Latin-1 bytes here, one a code point."""
    counts: Counter[bytes] = Counter()
    size = 0

    def out():
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(list(counts.values()), pa.int64())], schema=COUNTS)
    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            runs = Counter(RUN.findall(text.encode("latin-1", "replace").translate(LOWER)))  # no letter becomes "?"
            for run, n in runs.items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % DAMAGE == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
                    if len(run) < LEAST_LENGTH:
                        continue
                if run not in counts:
                    size += len(run)
                counts[run] += n
            if len(counts) > HELD_WORDS or size > HELD_BYTES:
                yield out()
                counts.clear()
                size = 0
    if counts:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of whole texts that occur often enough. Copies of a word meet in a
    task first, so a frequent word is sent about once per task."""
    taken = docs.select(F.col(id_col), whole_text(text_col))
    counted = taken.mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- numbered tries

def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by halves: long words are compared in slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Numbers the prefixes of sorted words: `path(word)` gives runs (upto, base), where the
    prefix of length i has the number base + i of the first run with i <= upto."""

    def __init__(self, first: int) -> None:
        self.next, self.word, self.runs = first, "", []

    def path(self, word: str, shared: int = 0, given: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """Prefixes up to `shared` have their numbers already, by the runs `given`."""
        kept = common_prefix(self.word, word)
        runs = [(min(upto, kept), base) for k, (upto, base) in enumerate(self.runs) if not k or self.runs[k - 1][0] < kept]
        if shared > kept:
            runs, kept = cut_runs(given, shared), shared
        if len(word) > kept:
            runs.append((len(word), self.next - kept - 1))
            self.next += len(word) - kept
        self.word, self.runs = word, [r for r in runs if r[0]]
        return self.runs


def cut_runs(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    return [(min(upto, length), base) for k, (upto, base) in enumerate(runs) if not k or runs[k - 1][0] < length]


NUMBERED = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("upto", pa.list_(pa.int32())), ("base", pa.list_(pa.int64()))])


def _numbering(borders: dict[int, tuple[str, list]]):
    """Paths of the sorted words of a range; borders: per range its last word and that word's path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie, near, place = None, None, [], 0
        for batch in batches:
            rows = []
            for part, key, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    now, trie, place = part, Trie((part + 1) << 36), part << 40
                    # only the last word of this range and of the one before can share nodes with others
                    before = max((p for p in borders if p < part), default=None)
                    near = [borders[p] for p in (before, part) if p is not None]
                shared, given = max(((common_prefix(key, w), g) for w, g in near), key=lambda x: x[0])
                runs, place = trie.path(key, shared, given), place + 1
                rows.append((place, word, n, [u for u, _ in runs], [b for _, b in runs]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), NUMBERED)], schema=NUMBERED)
    return run


def _with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int64()), *b.columns], names=["part", "key", "word", "n"])


def numbered(words: DataFrame, backwards: bool) -> DataFrame:
    """id, word, n, upto, base: the path of every word in the trie of words, or of reversed words;
    ids follow the code-point order of the words as the trie spells them."""
    key = F.reverse("word") if backwards else F.col("word")
    ranged = words.select(key.alias("key"), "word", "n").repartitionByRange("key").mapInArrow(_with_part, "part long, key string, word string, n long")
    ranged = materialize(ranged)
    # one word per range: as many as the table has partitions
    trie, borders = Trie(BORDER), {}
    for row in sorted(ranged.groupBy("part").agg(F.max("key").alias("last")).collect()):
        borders[row.part] = (row.last, list(trie.path(row.last)))
    ordered = ranged.repartition("part").sortWithinPartitions("part", "key")
    return ordered.mapInArrow(_numbering(borders), "id long, word string, n long, upto array<int>, base array<long>")


# ---- pairs

PAIRS = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("kind", pa.int8())])
WHOLE, LEFT_OUT, REPEATED = 0, 1, 2  # a cut; a position left out; the same one where the letter before is equal


def nodes(upto: list[int], base: list[int]) -> np.ndarray:
    """Node numbers of the prefixes of length 0, 1, ..."""
    if not upto:
        return np.zeros(1, np.int64)
    upto = np.array(upto)
    out = np.repeat(np.array(base, np.int64), np.diff(upto, prepend=0)) + np.arange(1, upto[-1] + 1)
    return np.concatenate([[0], out])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        cols = [np.concatenate(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PAIRS)], schema=PAIRS)
    for batch in batches:
        for word, key, n, fu, fb, bu, bb in zip(*(c.to_pylist() for c in batch.columns)):
            front, back = nodes(fu, fb), nodes(bu, bb)[::-1]  # back[i]: what begins at i
            length = len(word)
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            kind = np.full(2 * length + 1, WHOLE, np.int8)
            kind[length + 1:] = LEFT_OUT
            kind[length + 2:][letters[1:] == letters[:-1]] = REPEATED
            p, s = np.concatenate([front, front[:-1]]), np.concatenate([back, back[1:]])
            for k in range(0, len(p), PAIR_ROWS):
                part = slice(k, k + PAIR_ROWS)
                m = len(p[part])
                held.append((p[part], s[part], np.full(m, key), np.full(m, n), kind[part]))
                size += m
                if size >= PAIR_ROWS:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, best (struct of n and the negative id): per word with a near word the number
    of near words and the most frequent of them, from rows (id, word, n, upto, base, rupto, rbase)
    whose ids follow the order of the words.

    A pair gathers at most one entry per letter and the one word it cuts: lists stay small.
    """
    taken = words.select("word", "id", "n", "upto", "base", "rupto", "rbase")
    pairs = taken.mapInArrow(_pairs, "p long, s long, id long, n long, kind byte")
    met = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("m"), "kind")).alias("e")).where("size(e) > 1")
    others = F.transform("e", lambda x: F.struct(x["m"].alias("m"), F.filter("e", lambda y: _near(x, y)).alias("near")))
    rows = met.select(F.explode(others).alias("x")).select("x.*").where("size(near) > 0")
    counted = rows.select((-F.col("m")).alias("id"), F.size("near").cast("long").alias("n_near"), F.array_max(F.transform("near", lambda y: F.struct(y["n"], y["m"]))).alias("best"))
    return counted.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def _near(x, y):
    """Entries of one pair that are near: two that leave a position out, or one that does, at the
    first of equal letters, and the word it cuts."""
    replaced = (x["kind"] != WHOLE) & (y["kind"] != WHOLE) & (x["m"] != y["m"])
    inserted = ((x["kind"] == WHOLE) & (y["kind"] == LEFT_OUT)) | ((x["kind"] == LEFT_OUT) & (y["kind"] == WHOLE))
    return replaced | inserted


def roots(forms: DataFrame) -> DataFrame:
    """id, root from rows (id, form): the end of the chain of forms. A form is ten times as
    frequent, so chains are short; each round doubles the steps taken."""
    table = materialize(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = table.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = materialize(table.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("id", "root")
        table = after.select("id", "root")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n from rows (word, n) with distinct words.

    A word's form is its near word of largest n (the first in code-point order among equals) if
    that is ten times its own; root is the end of the chain of forms. Words without near words
    have no form and are their own root.
    """
    words = materialize(words.select("word", "n"))
    front = numbered(words, False)
    back = numbered(words, True).select("word", F.col("upto").alias("rupto"), F.col("base").alias("rbase"))
    both = materialize(front.join(back, "word"))
    near = neighbours(both).withColumn("form", -F.col("best")["m"])
    named = materialize(both.select("id", "word", "n").join(near, "id", "left"))
    has_form = F.col("best")["n"] >= DOMINANCE * F.col("n")
    forms = materialize(named.where(has_form).select("id", "form", F.col("best")["n"].alias("form_n")))
    chain = forms.select("id", "form", "form_n").join(roots(forms), "id")
    names = named.select(F.col("id").alias("other"), F.col("word").alias("name"))
    chain = chain.join(names.withColumnRenamed("name", "form_word"), F.col("form") == F.col("other")).drop("other")
    chain = chain.join(names.withColumnRenamed("name", "root_word"), F.col("root") == F.col("other")).select("id", "form_n", "form_word", "root_word")
    return named.join(chain, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of all words of whole texts.

    Null texts have no words; null ids are written as the empty text in checksums; repeated rows
    count each time; an empty table gives no rows; words and texts may have any length; other
    columns are ignored.
    """
    return variants(vocabulary(docs, id_col, text_col))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    """Every word of the documents with its form and root."""
    return spelling_variants(read(spark, sf_dir, "documents"))
