"""Byte-level BPE with a public vocabulary, over whole texts.

A text is cut into words by the vocabulary's pattern, and each word is merged with a segment tree: a leaf holds the
rank of an adjacent pair and its place, an inner node the least of its two children, so the root names the leftmost
pair of lowest rank; a merge updates three leaves in logarithmic time, until no pair can merge. A word of n bytes takes
O(n log n), which holds for minified files that are one word.

Words and whole lines repeat, so each worker keeps the ids of recent ones. A line end after a non-blank character
always starts a new word, so a text can be cut there without changing its ids. The caches only save time: they are
emptied when full.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies are; a parameter of every operator.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts a text into words before the merges (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
#: A worker remembers so many words and lines, lines of at most so many bytes in all, and nothing over LONGEST characters.
CACHED, CACHED_BYTES, LONGEST = 200_000, 64_000_000, 400


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """ids after all merges; pairs: left * 65536 + right -> merged id, lower ids first."""
    n = len(ids) - 1
    if n < 1:
        return ids
    get = pairs.get
    size = 1
    while size < n:
        size *= 2
    tree = [NONE] * (2 * size)
    for i in range(n):
        rank = get(ids[i] << 16 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while tree[1] != NONE:
        least = tree[1]
        i = least & 0xFFFFFFFF
        j = after[i]
        ids[i] = least >> 32
        ids[j] = -1
        k = after[i] = after[j]
        h = before[i]
        changed = [(j, NONE)]
        if k <= n:
            before[k] = i
            rank = get(ids[i] << 16 | ids[k])
            changed.append((i, NONE if rank is None else rank << 32 | i))
        else:
            changed.append((i, NONE))
        if h >= 0:
            rank = get(ids[h] << 16 | ids[i])
            changed.append((h, NONE if rank is None else rank << 32 | h))
        for leaf, value in changed:
            p = size + leaf
            if leaf >= n or tree[p] == value:
                continue
            tree[p] = value
            p >>= 1
            while p:
                a, b = tree[2 * p], tree[2 * p + 1]
                low = a if a < b else b
                if tree[p] == low:
                    break
                tree[p] = low
                p >>= 1
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes texts with the content of a rank file; ids come as the bytes of 32-bit integers in machine order.

    The vocabulary must hold all 256 bytes and fewer than 65536 ids, as a pair of ids is one key of 32 bits.
    """

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        if max(ranks.values(), default=0) >= 1 << 16:
            raise ValueError("the vocabulary has ids of 65536 or more")
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 16 | right] = rank
        self.words_any = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.words_ascii = re.compile(plain, re.ASCII).findall
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.line_bytes = 0

    def word(self, w: str) -> bytes:
        byte = self.byte
        out = array("i", merge([byte[x] for x in w.encode("utf-8", "replace")], self.pairs)).tobytes()
        if len(w) <= LONGEST:
            if len(self.words) >= CACHED:
                self.words.clear()
            self.words[w] = out
        return out

    def line(self, s: str) -> bytes:
        known = self.words
        out = b"".join([known.get(w) or self.word(w) for w in (self.words_ascii if s.isascii() else self.words_any)(s)])
        if len(s) <= LONGEST:
            self.line_bytes += len(s) + len(out)
            if len(self.lines) >= CACHED or self.line_bytes > CACHED_BYTES:
                self.lines.clear()
                self.line_bytes = len(s) + len(out)
            self.lines[s] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, parts, held = self.lines, [], ""
        lines = text.split("\n")
        first = True
        for s in lines:
            s = s if first else f"{held}\n{s}"
            first = False
            if s and not s[-1].isspace():
                parts.append(known.get(s) or self.line(s))
                held = ""
            else:  # a run of white space may go on beyond the line end
                held = s
        if held:
            parts.append(self.line(held))
        return b"".join(parts)


def read_vocabulary(ranks_file: str) -> bytes:
    """The content of a rank file, read on the driver and sent to the workers, whose nodes need not have it."""
    with open(ranks_file, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """One encoder per vocabulary, pattern and worker process."""
    return Encoder(vocabulary, pattern)


def _over_texts(df: DataFrame, text: str, keep: list[str], out: str, kind: str, ranks_file: str, pattern: str, make: Callable[[Encoder, pa.Array], pa.Array]) -> DataFrame:
    """keep columns plus a column made from the encoded texts of each batch; reads no other column."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(ranks_file))  # as large as the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], make(enc, batch.column(len(keep)))], names=[*keep, out])

    return df.select(*keep, df[text].alias("_tessera_text")).mapInArrow(run, f"{schema}, `{out}` {kind}")


def encode_texts(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "ids", ranks_file: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """The keep columns and the token ids (array<int>) of every row's text, without special tokens.

    NULL and empty texts give an empty list; strings that look like special tokens are ordinary text; texts are
    encoded whole, of any length; repeated rows stay; an empty table gives no rows. pattern is the vocabulary's own; it
    must start a new word after each line end that follows a non-blank character.
    """

    def make(enc: Encoder, texts: pa.Array) -> pa.Array:
        parts = [enc.encode(t) for t in texts.to_pylist()]
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    return _over_texts(df, text, keep or [], out, "array<int>", ranks_file, pattern, make)


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "n_tokens", ranks_file: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """The keep columns and the number of tokens (long) of every row's text; see encode_texts."""
    return _over_texts(df, text, keep or [], out, "bigint", ranks_file, pattern, lambda enc, texts: pa.array([len(enc.encode(t)) // 4 for t in texts.to_pylist()], pa.int64()))
