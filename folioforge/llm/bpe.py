"""Byte-level BPE by a monoid tree: encode halves, join neighbours by re-encoding a window around the seam.

``encode(a + b)`` is made from ``encode(a)`` and ``encode(b)``. The text is split by a fixed pattern before the merges,
and no match of it holds a white-space character after another kind of character. So wherever a non-space is followed
by a space a match ends, whatever surrounds it: tokens before the last such place in ``a`` and after the first in ``b``
are final. The window between the two is encoded anew. Where a single match is very long, the tokens in it are joined
in the same way by themselves: a sequence of tokens is the encoding of its bytes exactly if each neighbouring pair is
the encoding of the pair's bytes, so a window of tokens grows until both of its rims meet their neighbours as such
pairs. Decoding concatenates the tokens' bytes up the same tree.

Defined results: null and empty texts have no tokens; repeated rows stay repeated; a null ``doc_id`` passes through;
an empty table gives no rows. One batch of texts is held in memory at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import in_arrow

#: Characters (tokens, in decoding) of a leaf, and characters of a window from which its matches are looked at one by one.
LEAF, WINDOW = 256, 1024
_SEAM = regex.compile(r"[^\s\x1c-\x1f](?=[ \n])")
_SEAM_BACK = regex.compile(r"(?r)[^\s\x1c-\x1f](?=[ \n])")


class TreeBPE:
    """Encoder and decoder over a rank file; ``leaf`` and ``window`` are smaller in tests."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.pattern, self.leaf, self.window = regex.compile(pattern), leaf, window
        self.text_of = [str(i) for i in range(max(self.bytes_of, default=-1) + 1)]

    def encode(self, text: str, leaf: int = 1) -> list[int]:
        """The ids of ``text``: of its halves, joined. Only halves within a text are leaves; a whole text of two characters is halved too."""
        if len(text) <= leaf:
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        a, b = text[:half], text[half:]
        return self.join(a, self.encode(a, self.leaf), b, self.encode(b, self.leaf))

    def join(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """The encoding of ``a + b`` from those of ``a`` and ``b``."""
        at = m.end() if (m := _SEAM_BACK.search(a)) else 0
        to = m.end() if (m := _SEAM.search(b)) else len(b)
        keep, skip = self._tokens_back(left, a[at:]), self._tokens_on(right, b[:to])
        return left[:keep] + self._seam(a[at:], left[keep:], b[:to], right[:skip]) + right[skip:]

    def _tokens_back(self, ids: list[int], tail: str) -> int:
        n, k = len(tail.encode("utf-8", "surrogatepass")), len(ids)
        while n > 0:
            k -= 1
            n -= len(self.bytes_of[ids[k]])
        assert n == 0
        return k

    def _tokens_on(self, ids: list[int], head: str) -> int:
        n, k = len(head.encode("utf-8", "surrogatepass")), 0
        while n > 0:
            n -= len(self.bytes_of[ids[k]])
            k += 1
        assert n == 0
        return k

    def _seam(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        text = a + b
        if len(text) <= self.window:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        seam = len(a)
        for m in self.pattern.finditer(text):
            if m.start() < seam < m.end():
                first = self.pattern.match(b)
                if first and first.end() == m.end() - seam and m.start() == self._last_start(a):
                    tail, head = self._tokens_back(left, a[m.start() :]), self._tokens_on(right, b[: first.end()])
                    out += self._join_run(left[tail:], right[:head])
                    continue
            out += self._bytes(m[0].encode("utf-8", "surrogatepass"))
        return out

    def _last_start(self, a: str) -> int:
        last = 0
        for m in self.pattern.finditer(a):
            last = m.start()
        return last

    def _bytes(self, raw: bytes) -> list[int]:
        return self.encoding._encode_single_piece(raw)

    def _pair(self, x: int, y: int) -> bool:
        return self._bytes(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def _join_run(self, left: list[int], right: list[int]) -> list[int]:
        """Join two encodings inside one match: re-encode i tokens on either side until both rims are stable pairs."""
        i = 4
        while True:
            p, q = max(0, len(left) - i), min(len(right), i)
            mid = self._bytes(self.decode(left[p:]) + self.decode(right[:q]))
            if (p == 0 or self._pair(left[p - 1], mid[0])) and (q == len(right) or self._pair(mid[-1], right[q])):
                return left[:p] + mid + right[q:]
            i *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return b"".join([self.decode(ids[:half]), self.decode(ids[half:])])


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TreeBPE:
    """One encoder for each Python worker."""
    return TreeBPE(path, pattern)


def with_tokens(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for) of each text."""

    def step(part: pa.RecordBatch) -> dict:
        bpe = encoder(path, pattern)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for value in part.column(1).to_pylist():
            tokens = bpe.encode(value or "")
            out["n_tokens"].append(len(tokens))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, tokens)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(tokens)).hexdigest())
            if ids:
                out["ids"].append(tokens)
        return {key: part.column(0)} | out

    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids
    return in_arrow(df.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")), step, schema)
