"""Token counts with a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its
file and the library's version. Texts are joined by both digests to the counts stored in the
cache; only distinct texts without a stored count are encoded, and their counts are appended.

The tokenizer has no normaliser of its own, and its counts depend on every code point, so the
normalised content is the text itself with null as the empty text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held, query, read, scratch_dir, whole_text

# Unicode's white space. The pre-tokenizer never joins a character to white space that follows
# it, so a text falls into "white space, then none" fragments that are encoded alike alone.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FRAGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
# the tokenizer's own pattern, written out for the characters below U+0100 that are ASCII or letters
LETTER = r"a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[\\t-\\r -~{LETTER}]*")
PLAIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
# the visible character by which byte-level tokenizers write each byte
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
SYMBOL = {b: chr(b) for b in _shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _shown)}
MEMO_ENTRIES, MEMO_LENGTH = 400_000, 40  # per Python worker: counts of short fragments
CACHE_SCHEMA = pa.schema([("digest", pa.binary()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(path: str) -> str:
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def load(path: str):
    """The tokenizer and its memo, once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core

    def make():
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return tok, {}
    return held(f"token_counts {path}", make)


def count_text(tok, memo: dict, text: str) -> int:
    """Tokens of a text. Over ASCII and accented Latin letters a pattern finds the pre-tokens
    and each is encoded once per worker; other texts, and those that may hold special tokens,
    go to the library by fragments."""
    if PLAIN.fullmatch(text) and "<|" not in text:
        words, model = PLAIN_WORD.findall(text), tok.model
        if len(memo) > MEMO_ENTRIES:
            short = {w: n for w, n in memo.items() if len(w) <= 7}
            memo.clear()
            memo.update(short if len(short) < MEMO_ENTRIES // 2 else {})
        long = []
        for w in set(words):
            if w not in memo:
                memo[w] = len(model.tokenize(w.encode().decode("latin-1").translate(SYMBOL)))
                if len(w) > MEMO_LENGTH:
                    long.append(w)
        total = sum(map(memo.__getitem__, words))
        for w in long:
            del memo[w]
        return total
    parts = FRAGMENT.findall(text)
    new = list(dict.fromkeys(parts))
    found = {}
    for k in range(0, len(new), 5000):
        found.update(zip(new[k:k + 5000], map(len, tok.encode_batch_fast(new[k:k + 5000], add_special_tokens=False))))
    return sum(map(found.__getitem__, parts))


def _count_batches(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, memo = load(path)
        for b in batches:
            counts = [count_text(tok, memo, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(counts)), pa.array(counts, pa.int64())], schema=CACHE_SCHEMA)
    return run


def _stored(spark, cache: str, version: str) -> DataFrame | None:
    """Counts of this tokenizer in the cache; rows that two writers appended count once."""
    try:
        table = spark.read.parquet(cache)
    except Exception as e:  # noqa: BLE001 - only a cache that isn't there yet is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, n_bytes, n_tokens for every row; the cache (a folder all executors share)
    is read, extended by the misses and read again.

    Null and empty texts have zero bytes and tokens; repeated rows come out as often as they
    went in; null ids pass through. Copies are dropped within a task before the texts are
    shuffled, so a text that a third of the rows share is sent once per task.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    version = tokenizer_version(path)
    text = whole_text(text_col)
    keyed = docs.select(F.col(id_col), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    known = _stored(spark, cache, version)
    misses = keyed.select("digest", "text")
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    misses = misses.dropDuplicates(["digest"])
    misses.mapInArrow(_count_batches(path, version), "digest binary, tokenizer string, n_tokens long").write.mode("append").parquet(cache)
    return keyed.select(id_col, "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(_stored(spark, cache, version), "digest", "left")


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    """Tokens of every document, starting from an empty cache."""
    counted = count_tokens(read(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/token-counts")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
