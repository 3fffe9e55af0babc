"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can't be crossed by any merge: it marks a
certain cut. Texts are cut at such pairs, every fragment is encoded by itself, and the ids are
concatenated; the result equals that of the tokenizer on the whole text. The pairs are read
off the vocabulary file. White space occurs in no token of this vocabulary, so texts are first
cut there; what the library's own normaliser and pre-tokenizer leave of such a fragment is cut
again at the pairs between letters, digits and signs.

Encoding is a map over the documents. A worker remembers the ids of short fragments (a bounded
memo that only saves time).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held, query, read, whole_text

SPACES = " \t\n\r\x0b\x0c"
FRAGMENT = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# the tokenizer's own pattern, written out for the characters below U+0100 that are ASCII or letters
PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
MEMO_ENTRIES, MEMO_LENGTH = 300_000, 40


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[str, int]:
    """The visible character by which byte-level tokenizers write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def inner_pairs(vocab: dict[str, int], suffix: str) -> np.ndarray:
    """256 x 256: whether the second byte follows the first inside any token."""
    code = byte_symbols()
    seen = np.zeros((256, 256), bool)
    for token in vocab:
        body = token.removesuffix(suffix) if suffix else token
        raw = [code[c] for c in body if c in code]
        if len(raw) == len(body) > 1:
            seen[raw[:-1], raw[1:]] = True
    return seen


class Codec:
    """Encodes and decodes whole texts exactly as the tokenizer of the file does with
    add_special_tokens=False and skip_special_tokens=False."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"truncation": None, "padding": None}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.whole = Tokenizer.from_str(json.dumps(spec))
        # the same merges without the mark of a word's end, for all but the last fragment of a word
        self.inner = Tokenizer.from_str(json.dumps(spec | {"model": spec["model"] | {"end_of_word_suffix": None}, "added_tokens": []})).model
        self.last = self.whole.model
        self.code, self.pairs = byte_symbols(), inner_pairs(spec["model"]["vocab"], suffix)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if self.pairs[:, [ord(c) for c in SPACES]].any() or self.pairs[[ord(c) for c in SPACES], :].any():
            raise ValueError("this vocabulary joins white space to other characters")
        if spec["decoder"] is not None:
            raise ValueError("only tokenizers without a decoder, whose tokens are joined by spaces, are decoded by fragments")
        self.symbol = {b: c for c, b in self.code.items()}
        self.ids: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def cuts(self, word: str) -> list[str]:
        """A pre-token cut at every byte pair that no token holds."""
        raw = [self.code[c] for c in word]
        at = [0, *(np.flatnonzero(~self.pairs[raw[:-1], raw[1:]]) + 1).tolist(), len(raw)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def _word(self, word: str) -> None:
        """Remembers the ids (little-endian 32-bit integers) and tokens of a pre-token, which is
        written in byte symbols, by its plain form."""
        raw = word.encode().decode("latin-1").translate(self.symbol)
        ids, tokens = [], []
        pieces = self.cuts(raw)
        for piece in pieces[:-1]:
            for t in self.inner.tokenize(piece):
                ids.append(t.id)
                tokens.append(t.value)
        for t in self.last.tokenize(pieces[-1]):
            ids.append(t.id)
            tokens.append(t.value)
        self.ids[word], self.tokens[word] = np.asarray(ids, "<u4").tobytes(), " ".join(tokens).encode()

    def _words(self, text: str) -> list[str]:
        """Pre-tokens of a text. Over ASCII and accented Latin letters a pattern finds them;
        else the library's own normaliser and pre-tokenizer, on fragments between white space."""
        if PLAIN.fullmatch(text):
            return PLAIN_WORD.findall(text.lower())
        out = []
        for piece in FRAGMENT.findall(text):
            if PLAIN.fullmatch(piece):
                out += PLAIN_WORD.findall(piece.lower())
            else:
                for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(piece)):
                    out.append(bytes(map(self.code.__getitem__, word)).decode())
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and their tokens joined by spaces."""
        if self.special and any(s in text for s in self.special):
            found = self.whole.encode(text, add_special_tokens=False)
            return np.asarray(found.ids, "<u4").tobytes(), " ".join(found.tokens).encode()
        words = self._words(text)
        if len(self.ids) > MEMO_ENTRIES:
            self._forget()
        for w in set(words):
            if w not in self.ids:
                self._word(w)
        out = b"".join(map(self.ids.__getitem__, words)), b" ".join(map(self.tokens.__getitem__, words))
        for w in words:
            if len(w) > MEMO_LENGTH and w in self.ids:
                del self.ids[w], self.tokens[w]
        return out

    def _forget(self) -> None:
        short = [w for w in self.ids if len(w) <= 7]
        short = short if len(short) < MEMO_ENTRIES // 2 else []
        self.ids, self.tokens = {w: self.ids[w] for w in short}, {w: self.tokens[w] for w in short}

    def decode(self, ids: bytes) -> str:
        """Tokens of any id sequence, joined by spaces."""
        table = self.whole.id_to_token
        return " ".join(t for k in np.frombuffer(ids, "<u4").tolist() if (t := table(k)) is not None)


def load(path: str) -> Codec:
    return held(f"bpe_codec {path}", lambda: Codec(path))


def _mapped(path: str, kind: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids, decoded = codec.encode(text)
                if kind == "digest":
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    rows.append((np.frombuffer(ids, "<u4").astype("i4"), decoded.decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)
    return run


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), decoded: one row per input row. Null and empty texts, and those
    of white space only, have no ids and decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    taken = docs.select(F.col(id_col).cast("long"), whole_text(text_col))
    return taken.mapInArrow(_mapped(tokenizer or default_tokenizer(), "ids", schema), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents() in digest form."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    taken = docs.select(F.col(id_col).cast("long"), whole_text(text_col))
    return taken.mapInArrow(_mapped(tokenizer or default_tokenizer(), "digest", schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op6_bpe_codec")
def op6_bpe_codec(spark, sf_dir):
    """Token ids of every document and their decoded text, as digests."""
    return encode_digests(read(spark, sf_dir, "documents"))
