"""Line dedup: an exact set-similarity join of lines, which removes every later match.

A line is the set of its words (A-Z lower-cased, parted by ASCII white space). A line is removed if the same set, or one
with a Jaccard similarity of 0.8 or more, stands earlier: at a smaller doc_id, or earlier in the same text. Lines without
a word always stay. The earlier line counts even if it is itself removed.

How: words are counted over all documents in a hashed table of fixed size; each line's words are ordered by rarity.
Lines of equal sets become one class with its first place. Each class is posted under the words of its prefix, the
rarest n - ceil(0.8 n) + 1; sets of less than four words are not posted, as only equal sets are similar to them. Classes
that meet under a word pass the length filter, the positional filter and a bitmap filter, wider for long lines (each of
which drops only pairs that cannot reach 0.8). Of the pairs that remain, each later class hands on its two most
promising ones, which are verified on the full sets. Later classes still without a match that may have more pairs go
through a second round with all of them, so nothing is lost.

Large groups of alike lines: under a word with many classes, those next to each other in the order of their bitmaps are
tried first, and a class that finds two promising partners so tries no others in the first round. A word with more
than HOT classes is dealt in parts; the first round joins within a part, and in the second round the classes that are
still without a match are tried against every part.

Defined results: a null text stays null, an empty one empty; rows without a doc_id come last, in the order of their
texts' hashes, as do rows that share one doc_id among themselves; of rows with equal doc_id and equal text the first one
in the order of reading counts as the earliest; a document left without a line has an empty text; only the named columns
are read; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Marks, bounded_batches, cut, drop, flat, free_name, groups, lowered, mapped, marked, mix, partitions, runs_of, slices, span_hashes, summed, word_spans

COUNTED = 1 << 20
#: Similarity as a fraction.
UP, DOWN = 4, 5
#: Place of rows without a doc_id.
NO_ID = (1 << 63) - 1
#: Words from which a line has a bitmap of WIDE more 64-bit words.
WIDE_FROM, WIDE = 176, 8
#: Candidates of a later class that are verified in the first round.
FIRST = 2
#: Classes under a word from which neighbours are tried first, and from which the word is dealt in parts.
CROWD, HOT = 1024, 1 << 14
#: Bytes of postings that a task takes at once; a partition with more is cut into blocks, which it takes one after the other.
BLOCK = 64 << 20
#: Pairs that are tested at once, and bytes of classes or postings that a task holds before it hands them on.
AT_ONCE, HELD = 1 << 18, 16 << 20
#: Lines up to which their documents are picked by a broadcast join.
FEW = 1 << 14
#: Later lines that one task verifies against one earlier line.
PART = 1024

_HEAD = np.dtype([("key", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("line", "<i4"), ("size", "<i4"), ("low", "<u8"), ("high", "<u8"), ("prefix", "<i4"), ("loose", "u1")])
_POST = np.dtype([("word", "<u4"), ("key", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("line", "<i4"), ("size", "<i4"), ("at", "<i4"), ("low", "<u8"), ("high", "<u8"), ("role", "u1")])
#: Roles of a posting: under a word in parts; of a class that is asked for; in the class's own part.
SPLIT, ASKED, OWN = 1, 2, 4


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap with which sets of these sizes are similar."""
    return -(-UP * (a + b) // (UP + DOWN))


def line_words(data: np.ndarray, offsets: np.ndarray):
    """Of lines with a word: their rows, line numbers, and bounds in the list of word spans; and the spans."""
    starts, ends, _ = word_spans(data, offsets)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    row = np.searchsorted(offsets, starts, side="right") - 1
    line = breaks[starts] - breaks[offsets[row]] if len(starts) else starts
    new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(line) != 0)])) if len(starts) else starts
    return row[new], line[new], new, np.diff([*new, len(starts)]), starts, ends


def line_sets(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, ask=None):
    """(rows, line numbers, sizes, bounds, words): the distinct words' hashes of each line, rarest first; of the lines that ``ask`` picks by row and number, if given."""
    row, line, first, many, starts, ends = line_words(data, offsets)
    if ask is not None:
        picked = ask(row, line)
        row, line, first, many = row[picked], line[picked], first[picked], many[picked]
    at = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
    hashes = span_hashes(lowered(data), starts[at], ends[at])
    own = np.repeat(np.arange(len(row)), many)
    rarity = counts[(hashes % np.uint64(COUNTED)).astype(np.int64)].astype(np.uint64)
    rank = (rarity << np.uint64(36)) | (hashes >> np.uint64(28))
    if len(row) < 1 << 20:
        order = np.argsort((own.astype(np.uint64) << np.uint64(44)) | rank)
    else:
        order = np.lexsort((hashes, rank, own))
    hashes, own = hashes[order], own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    hashes, own = hashes[fresh], own[fresh]
    bounds = np.searchsorted(own, np.arange(len(row) + 1))
    return row, line, np.diff(bounds), bounds, hashes


def count_words(df: DataFrame) -> np.ndarray:
    """How common the words of a bucket are, on a scale of powers of the fourth root of two, in a byte."""

    def counts(part: pa.RecordBatch) -> np.ndarray:
        data, offsets = flat(part.column(0))
        starts, ends, _ = word_spans(data, offsets)
        return np.bincount((span_hashes(lowered(data), starts, ends) % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)

    return np.minimum(255, np.log2(summed(df.select("text"), counts, COUNTED) + 1.0) * 4).astype(np.uint8)


def _keys(sizes: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(mix(np.add.reduceat(mix(words ^ np.uint64(seed)), bounds[:-1]) + sizes.astype(np.uint64)) for seed in (0x7F4A7C15, 0x3C6EF372))


def _take_runs(flat_values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return flat_values[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Classes(NamedTuple):
    """Classes of equal lines: their heads, the words of their prefixes end to end, and the wide bitmaps of those that have one."""

    heads: np.ndarray
    tokens: np.ndarray
    wide: np.ndarray

    def take(self, at: np.ndarray) -> Classes:
        sizes = self.heads["prefix"].astype(np.int64)
        return Classes(self.heads[at], _take_runs(self.tokens, (np.cumsum(sizes) - sizes)[at], sizes[at]), self.wide[_wide_at(self.heads)[at[self.heads["size"][at] >= WIDE_FROM]]])

    def firsts(self) -> Classes:
        """Each class once, with its first place."""
        h = self.heads
        order = np.lexsort((h["line"], h["tie"], h["doc"], h["check"], h["key"]))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h["key"][order[1:]] != h["key"][order[:-1]]) | (h["check"][order[1:]] != h["check"][order[:-1]])
        return self.take(order[fresh])

    def raw(self) -> bytes:
        return len(self.heads).to_bytes(8, "little") + len(self.wide).to_bytes(8, "little") + _by_bytes(self.heads) + self.wide.tobytes() + self.tokens.tobytes()


def _wide_at(rows: np.ndarray) -> np.ndarray:
    """Where the wide bitmaps of rows stand, in the list of those that have one."""
    return np.cumsum(rows["size"] >= WIDE_FROM) - 1


def _by_bytes(rows: np.ndarray) -> bytes:
    """Fixed-size rows with their first bytes together, then their second bytes, and so on: leading zeros compress well."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), rows.itemsize).T).tobytes()


def _from_bytes(raw: bytes, kind: np.dtype, many: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, many * kind.itemsize, at).reshape(kind.itemsize, many).T).view(kind)[:, 0] if many else np.zeros(0, kind)


def _unpacked(blocks: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, what follows their wide bitmaps, and the wide bitmaps of some blocks."""
    rows, tokens, wide = [np.zeros(0, kind)], [np.zeros(0, "<u4")], [np.zeros((0, WIDE), "<u8")]
    for raw in blocks:
        n, k = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
        at = 16 + n * kind.itemsize
        rows.append(_from_bytes(raw, kind, n, 16))
        wide.append(np.frombuffer(raw, "<u8", k * WIDE, at).reshape(k, WIDE))
        tokens.append(np.frombuffer(raw, "<u4", -1, at + 8 * k * WIDE))
    return np.concatenate(rows), np.concatenate(tokens), np.concatenate(wide)


def _blocks(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "packed"])


def _dealt(df: DataFrame) -> DataFrame:
    """(block, packed) with each block in one task, one after the other."""
    many = partitions(df.sparkSession)
    return df.repartitionById(many, F.pmod(F.col("block"), F.lit(many)).cast("int")).sortWithinPartitions("block")


def _ties(docs: np.ndarray, ties: np.ndarray, loose: Marks | None) -> np.ndarray:
    """What parts rows of one doc_id: their text's hash; 0 for most rows whose doc_id stands once."""
    shared = docs == NO_ID
    if loose is not None:
        shared |= loose.has(docs)
    return np.where(shared, ties, 0)


def bitmaps(sizes: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set the parity of its words in each of 128 bits, in two halves, and of long sets in 64 * WIDE bits; symmetric differences show as bits that differ."""
    if not len(sizes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, WIDE), np.uint64)
    place = (words >> np.uint64(8)) % np.uint64(64 * WIDE)
    bit, upper = np.uint64(1) << (place & np.uint64(63)), (place >> np.uint64(6)) & np.uint64(1)
    low, high = (np.bitwise_xor.reduceat(bit * half, bounds[:-1]) for half in (np.uint64(1) - upper, upper))
    long = np.flatnonzero(sizes >= WIDE_FROM)
    wide = np.zeros((len(long), WIDE), np.uint64)
    if len(long):
        at = np.arange(int(sizes[long].sum())) + np.repeat(bounds[:-1][long] - (np.cumsum(sizes[long]) - sizes[long]), sizes[long])
        first = np.cumsum(sizes[long]) - sizes[long]
        for k in range(WIDE):
            wide[:, k] = np.bitwise_xor.reduceat(np.where(place[at] >> np.uint64(6) == k, bit[at], np.uint64(0)), first)
    return low, high, wide


def classes(df: DataFrame, counts, loose) -> DataFrame:
    """(packed, many): the classes of all lines, each once, some to a row. ``df`` has doc, tie and text."""
    many = partitions(df.sparkSession)

    def run(batches):
        held: list[Classes] = []
        size = 0

        def flush():
            own = Classes(*(np.concatenate(x) for x in zip(*held))).firsts()
            block = (own.heads["key"] % np.uint64(many)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            return _blocks((int(block[order[a]]), own.take(order[a:b]).raw()) for a, b in runs_of(block[order]))

        for batch in batches:
            for part in slices(batch, "text"):
                docs, ties = np.asarray(part.column(0)), np.asarray(part.column(1))
                row, line, sizes, bounds, words = line_sets(*flat(part.column(2)), counts.value)
                if not len(row):
                    continue
                h = np.zeros(len(row), _HEAD)
                h["key"], h["check"] = _keys(sizes, bounds, words)
                h["low"], h["high"], wide = bitmaps(sizes, bounds, words)
                h["prefix"] = np.where(DOWN * sizes >= UP * (sizes + 1), sizes - -(-UP * sizes // DOWN) + 1, 0)
                h["doc"], h["tie"], h["line"], h["size"] = docs[row], ties[row], line, sizes
                h["loose"] = _ties(docs, np.ones(len(docs), np.int64), loose.value)[row]
                tokens = (_take_runs(words, bounds[:-1], h["prefix"].astype(np.int64)) >> np.uint64(16)).astype(np.uint32)
                held.append(Classes(h, tokens, wide))
                size += sum(x.nbytes for x in held[-1])
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(batches):
        for parts in groups(batches, 1):
            heads, tokens, wide = _unpacked([x for p in parts for x in p.column(1).to_pylist()], _HEAD)
            own = Classes(heads, tokens, wide).firsts()
            yield pa.RecordBatch.from_arrays([pa.array([own.raw()], pa.binary()), pa.array([len(own.heads)], pa.int64())], names=["packed", "many"])

    return mapped(_dealt(mapped(df, run, "block int, packed binary")), merge, "packed binary, many long")


def _each(batches):
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            yield Classes(*_unpacked([raw], _HEAD))


def first_places(own: DataFrame) -> DataFrame:
    """(key, doc, tie, line) of each class."""

    def run(batches):
        for c in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c.heads["key"].view(np.int64)), *(pa.array(c.heads[x]) for x in ("doc", "tie", "line"))], names=["key", "doc", "tie", "line"])

    return mapped(own.select("packed"), run, "key long, doc long, tie long, line int")


def posted_words(own: DataFrame) -> np.ndarray:
    """How many postings the words of a bucket have."""

    def counts(part: pa.RecordBatch) -> np.ndarray:
        return sum((np.bincount(_bucket(c.tokens), minlength=COUNTED) for c in _each([part])), np.zeros(COUNTED, np.int64))

    return summed(own.select("packed"), counts, COUNTED)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens.astype(np.uint64)) % np.uint64(COUNTED)).astype(np.int64)


def _in_part(tokens: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A word's name in a part; in the first part it is its own."""
    return np.where(part > 0, mix(tokens.astype(np.uint64) | (part.astype(np.uint64) << np.uint64(32))), tokens).astype(np.uint32)


def postings(own: DataFrame, splits, blocks: int, asked=None, words=None) -> DataFrame:
    """(block, packed): the classes' postings, dealt by word and part. With ``asked`` and ``words``, only those under marked words; classes asked for go to every part."""

    def posted(c: Classes) -> tuple[np.ndarray, np.ndarray]:
        sizes = c.heads["prefix"].astype(np.int64)
        head = np.repeat(np.arange(len(c.heads)), sizes)
        at = np.arange(len(c.tokens)) - (np.cumsum(sizes) - sizes)[head]
        tokens, ask = c.tokens, np.zeros(len(c.heads), bool)
        if asked is not None:
            ask = asked.value.has(c.heads["key"])
            here = words.value.has(tokens)
            head, at, tokens = head[here], at[here], tokens[here]
        in_parts = splits.value[_bucket(tokens)].astype(np.int64)
        mine = (mix(c.heads["key"][head]) % in_parts.astype(np.uint64)).astype(np.int64)
        copies = np.where(ask[head], in_parts, 1)
        first = np.cumsum(copies) - copies
        source = np.repeat(np.arange(len(head)), copies)
        part = (mine[source] + np.arange(len(source)) - first[source]) % in_parts[source]
        head, at, tokens = head[source], at[source], tokens[source]
        post = np.zeros(len(source), _POST)
        post["word"], post["at"] = _in_part(tokens, part), at
        for name in ("key", "doc", "line", "size", "low", "high"):
            post[name] = c.heads[name][head]
        post["tie"] = np.where(c.heads["loose"][head] > 0, c.heads["tie"][head], 0)
        post["role"] = SPLIT * (in_parts[source] > 1) + ASKED * ask[head] + OWN * (part == mine[source])
        return post, c.wide[_wide_at(c.heads)[head[post["size"] >= WIDE_FROM]]]

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            post, wide = (np.concatenate(x) for x in zip(*held))
            block = (mix(post["word"].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            post, wide = post[order], wide[_wide_at(post)[order[post["size"][order] >= WIDE_FROM]]]
            where = np.concatenate([[0], np.cumsum(post["size"] >= WIDE_FROM)])
            return _blocks((int(block[order[a]]), (b - a).to_bytes(8, "little") + int(where[b] - where[a]).to_bytes(8, "little") + _by_bytes(post[a:b]) + wide[where[a] : where[b]].tobytes()) for a, b in runs_of(block[order]))

        for c in _each(batches):
            held.append(posted(c))
            size += sum(x.nbytes for x in held[-1])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return _dealt(mapped(own.select("packed"), run, "block int, packed binary"))


class Posts:
    """The postings of a block, by word and size."""

    def __init__(self, blocks: list[bytes]):
        rows, _, wide = _unpacked(blocks, _POST)
        order = np.argsort((rows["word"].astype(np.uint64) << np.uint64(32)) | rows["size"].astype(np.uint64), kind="stable")
        self.wide_at = _wide_at(rows)[order]
        self.rows, self.wide = rows[order], wide
        self.size = self.rows["size"].astype(np.int64)
        self.words = runs_of(self.rows["word"])
        begin = np.array([a for a, _ in self.words], np.int64)
        self.base = np.repeat(np.arange(len(begin)) << 32, np.diff([*begin, len(rows)]))

    def fitting(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that pass the filters, the later one first, with how far apart they are."""
        size, rows = self.size, self.rows
        both = size[left] + size[right]
        room = both - 2 * needed(size[left], size[right])
        apart = np.bitwise_count(rows["low"][left] ^ rows["low"][right]).astype(np.int64) + np.bitwise_count(rows["high"][left] ^ rows["high"][right])
        fit = np.flatnonzero(apart <= room)
        left, right, both, apart, room = left[fit], right[fit], both[fit], apart[fit], room[fit]
        i, j = rows["at"][left].astype(np.int64), rows["at"][right].astype(np.int64)
        most = np.minimum(i, j) + 1 + np.minimum(size[left] - 1 - i, size[right] - 1 - j)
        long = np.flatnonzero((size[left] >= WIDE_FROM) & (size[right] >= WIDE_FROM))
        apart[long] = np.bitwise_count(self.wide[self.wide_at[left[long]]] ^ self.wide[self.wide_at[right[long]]]).sum(axis=1, dtype=np.int64)
        fit = (apart <= room) & (most >= needed(size[left], size[right])) & (rows["key"][left] != rows["key"][right])
        left, right, apart = left[fit], right[fit], apart[fit] / both[fit]
        swap = ~self.later(left, right)
        return np.where(swap, right, left), np.where(swap, left, right), apart

    def later(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first of a pair stands later than the second."""
        a, b = self.rows[a], self.rows[b]
        out, same = a["doc"] > b["doc"], a["doc"] == b["doc"]
        for name in ("tie", "line", "key"):
            out |= same & (a[name] > b[name])
            same &= a[name] == b[name]
        return out

    def meetings(self, lefts: np.ndarray, all_sizes: bool):
        """Pairs of ``lefts`` with the others of their word that pass the filters, some at a time: with all of them, or only with those that come after."""
        key = self.base + self.size
        begin = np.searchsorted(key, self.base[lefts] - (-UP * self.size[lefts] // DOWN), side="left") if all_sizes else lefts + 1
        stop = np.searchsorted(key, self.base[lefts] + DOWN * self.size[lefts] // UP, side="right")
        many = stop - begin
        done = np.cumsum(many)
        start = 0
        while start < len(lefts):
            end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + AT_ONCE, side="right")))
            own = many[start:end]
            left = np.repeat(lefts[start:end], own)
            right = np.repeat(begin[start:end], own) + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
            yield left, right
            start = end

    def neighbours(self, a: int, b: int, near: int = 12, heads: int = 16):
        """Pairs of postings a to b that stand close in the order of their bitmaps, and pairs with the earliest ones."""
        rows = self.rows[a:b]
        for name in ("low", "high"):
            order = a + np.lexsort((rows["key"], rows[name]))
            for k in range(1, near + 1):
                yield order[:-k], order[k:]
        first = a + np.lexsort((rows["line"], rows["tie"], rows["doc"]))[:heads]
        for x in first.tolist():
            others = np.arange(a, b)
            yield np.full(b - a, x), others


_ENDS = ("key", "doc", "tie", "line")
_PAIR = [f"{end}_{name}" for end in ("later", "earlier") for name in _ENDS]
_PAIR_DDL = ", ".join(f"{x} {'int' if x.endswith('line') else 'long'}" for x in _PAIR)


def _ends(post: np.ndarray, later: np.ndarray, earlier: np.ndarray) -> list:
    return [pa.array(post[name][at].view(np.int64) if name == "key" else post[name][at]) for at in (later, earlier) for name in _ENDS]


class Nearest:
    """The FIRST nearest partners of each later class, of pairs that come some at a time, and the classes that have more."""

    def __init__(self, key: np.ndarray):
        self.key, self.more = key, [np.zeros(0, np.uint64)]
        self.now = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held: list = []
        self.size = 0

    def add(self, later: np.ndarray, earlier: np.ndarray, apart: np.ndarray) -> None:
        if len(later):
            self.held.append((later, earlier, apart))
            self.size += len(later)
        if self.size > AT_ONCE:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        later, earlier, apart = (np.concatenate(x) for x in zip(self.now, *self.held))
        a, b = self.key[later], self.key[earlier]
        order = np.lexsort((b, apart, a))
        a, b, later, earlier, apart = a[order], b[order], later[order], earlier[order], apart[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, later, earlier, apart = a[fresh], later[fresh], earlier[fresh], apart[fresh]
        runs = np.array(runs_of(a), np.int64).reshape(-1, 2)
        rank = np.arange(len(a)) - np.repeat(runs[:, 0], runs[:, 1] - runs[:, 0])
        self.more.append(np.unique(a[rank >= FIRST]))
        few = rank < FIRST
        self.now, self.held, self.size = (later[few], earlier[few], apart[few]), [], 0
        return self.now


def candidates(posted: DataFrame) -> DataFrame:
    """(later_key, best, more): each later class with its nearest earlier ones, and whether it may have others."""

    def run(batches):
        for parts in groups(batches, 1):
            post = Posts([x for p in parts for x in p.column(1).to_pylist()])
            near = Nearest(post.rows["key"])
            near.more.append(np.unique(post.rows["key"][post.rows["role"] & SPLIT > 0]))
            few = np.ones(len(post.rows), bool)
            for a, b in post.words:
                if b - a <= CROWD:
                    continue
                few[a:b] = False
                own = Nearest(post.rows["key"])
                for left, right in post.neighbours(a, b):
                    own.add(*post.fitting(left, right))
                found = own.settle()
                near.add(*found)
                rows, many = np.unique(found[0], return_counts=True)
                content = np.isin(np.arange(a, b), rows[many == FIRST])
                near.more.append(np.unique(post.rows["key"][a:b][content]))
                for left, right in post.meetings(np.flatnonzero(~content) + a, True):
                    later, earlier, apart = post.fitting(left, right)
                    near.add(later, earlier, apart)
            for left, right in post.meetings(np.flatnonzero(few), False):
                near.add(*post.fitting(left, right))
            later, earlier, apart = near.settle()
            yield pa.RecordBatch.from_arrays([pa.array(apart), *_ends(post.rows, later, earlier), pa.array(np.zeros(len(apart), bool))], names=["apart", *_PAIR, "more"])
            more = np.unique(np.concatenate(near.more)).view(np.int64)
            none = [pa.nulls(len(more), pa.int32() if x.endswith("line") else pa.int64()) for x in _PAIR[1:]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.float64()), pa.array(more), *none, pa.array(np.ones(len(more), bool))], names=["apart", *_PAIR, "more"])

    found = mapped(posted, run, f"apart double, {_PAIR_DDL}, more boolean")
    best = F.array_sort(F.collect_set(F.when(F.col("earlier_key").isNotNull(), F.struct("apart", *_PAIR))))
    of_one = found.groupBy("later_key").agg(best.alias("all"), F.max("more").alias("more"))
    return of_one.select("later_key", F.slice("all", 1, FIRST).alias("best"), (F.col("more") | (F.size("all") > FIRST)).alias("more"))


def all_candidates(posted: DataFrame) -> DataFrame:
    """All pairs of the later classes that are asked for."""

    def run(batches):
        for parts in groups(batches, 1):
            post = Posts([x for p in parts for x in p.column(1).to_pylist()])
            role = post.rows["role"]
            for left, right in post.meetings(np.flatnonzero(role & ASKED), True):
                own = role[right] & OWN > 0
                later, earlier, _ = post.fitting(left[own], right[own])
                ask = role[later] & ASKED > 0
                later, earlier = later[ask], earlier[ask]
                if len(later):
                    _, once = np.unique(post.rows["key"][later] * np.uint64(3) + post.rows["key"][earlier], return_index=True)
                    yield pa.RecordBatch.from_arrays(_ends(post.rows, later[once], earlier[once]), names=_PAIR)

    return mapped(posted, run, _PAIR_DDL).distinct()


def _short(words: np.ndarray) -> bytes:
    """Word hashes in 48 bits each."""
    return words.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _places(docs: np.ndarray, ties: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return mix(docs.view(np.uint64) ^ mix(ties.view(np.uint64))) + lines.astype(np.uint64)


def _texts(docs: np.ndarray, ties: np.ndarray) -> np.ndarray:
    return _places(docs, ties, np.full(len(docs), 1 << 32))


def sets_of(df: DataFrame, counts, loose, wanted, wanted_texts) -> DataFrame:
    """(own_key, own_doc, own_tie, own_line, words): the sets of the lines whose place is marked, as 48-bit hashes. Texts without a mark are passed over."""

    def run(batches):
        for batch in batches:
            ties = _ties(np.asarray(batch.column(0)), np.asarray(batch.column(1)), loose.value)
            batch = pa.RecordBatch.from_arrays([batch.column(0), pa.array(ties, pa.int64()), batch.column(2)], names=["doc", "tie", "text"])
            batch = batch.filter(pa.array(wanted_texts.value.has(_texts(np.asarray(batch.column(0)), ties))))
            for part in slices(batch, "text"):
                docs, ties = np.asarray(part.column(0)), np.asarray(part.column(1))
                row, line, sizes, bounds, words = line_sets(*flat(part.column(2)), counts.value, lambda row, line: wanted.value.has(_places(docs[row], ties[row], line)))
                key, _ = _keys(sizes, bounds, words)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(docs[row]), pa.array(ties[row]), pa.array(line.astype(np.int32)), pa.array([_short(words[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["own_key", "own_doc", "own_tie", "own_line", "words"])

    return mapped(df, run, "own_key long, own_doc long, own_tie long, own_line int, words binary")


def verified(df: DataFrame, counts, loose, pairs: DataFrame) -> DataFrame:
    """(later): the keys of later classes whose set is similar to that of a partner in ``pairs``.

    Each line that is in a pair sends its set to its earlier line's group, once for each; a group of many later lines is
    dealt in parts, each with the earlier line's set.
    """
    spark = df.sparkSession
    place = lambda end: F.struct(*[F.col(f"{end}_{x}").alias(x) for x in _ENDS])
    many = pairs.groupBy(F.col("earlier_key").alias("of_key")).agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("later_key"), F.col("parts"))
    target = lambda end, role: F.struct(place(end).alias("at"), F.col("earlier_key").alias("group"), part.alias("part"), F.lit(role).alias("role"))
    sent = pairs.join(many, F.col("earlier_key") == F.col("of_key")).select(F.explode(F.array(target("earlier", 0), target("later", 1))).alias("x"))
    sent = cut(sent.select("x.at.key", "x.at.doc", "x.at.tie", "x.at.line", "x.group", "x.part", "x.role").distinct())
    places = sent.select("doc", "tie", "line").distinct()
    n = sent.count()
    columns = lambda part: [np.asarray(part.column(i)).astype(np.int64) for i in range(3)]
    wanted = spark.sparkContext.broadcast(marked(places, lambda part: _places(*columns(part)), n))
    wanted_texts = spark.sparkContext.broadcast(marked(places, lambda part: _texts(*columns(part)[:2]), n))
    if n <= FEW:
        of_line = places.select(F.col("doc").alias("of_doc")).distinct()
        df = df.join(F.broadcast(of_line), F.col("doc") == F.col("of_doc"), "left_semi")
    sets = sets_of(df, counts, loose, wanted, wanted_texts)
    joined = sets.join(sent, (F.col("own_key") == F.col("key")) & (F.col("own_doc") == F.col("doc")) & (F.col("own_line") == F.col("line")) & (F.col("own_tie") == F.col("tie")))
    dealt = joined.select("group", "part", "role", "key", "words").repartition(partitions(spark), "group", "part").sortWithinPartitions("group", "part", "role")

    def run(batches):
        last, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for group, piece, role, key, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = _long(raw)
                if not role:
                    last, base = (group, piece), own
                elif last == (group, piece):
                    both = len(own) + len(base) - len(np.unique(np.concatenate([own, base])))
                    if DOWN * both >= UP * (len(own) + len(base) - both):
                        found.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["later"])

    out = cut(mapped(dealt, run, "later long").distinct())
    drop(sent)
    return out


def stays(df: DataFrame) -> tuple[DataFrame, bool]:
    """(stay_doc, stay_tie, stay): of each document of ``df`` (doc, tie, text) the numbers of the lines that stay; and whether there may be equal documents."""
    spark = df.sparkSession
    bounded_batches(spark)
    send = spark.sparkContext.broadcast
    twice = cut(df.groupBy("doc").count().where("count > 1").select("doc"))
    n = twice.count()
    loose = send(marked(twice, lambda part: np.asarray(part.column(0)), n) if n else None)
    drop(twice)
    counts = send(count_words(df))
    own = cut(classes(df, counts, loose))
    many = posted_words(own)
    blocks = partitions(spark) * (1 + int(many.sum()) * _POST.itemsize // (partitions(spark) * BLOCK))
    splits = send(np.maximum(1, -(-many // HOT)).astype(np.uint32))
    found = cut(candidates(postings(own, splits, blocks)))
    pairs = found.select(F.explode("best").alias("x")).select(*[F.col(f"x.{x}").alias(x) for x in _PAIR])
    gone = verified(df, counts, loose, pairs)
    still = cut(found.where("more").select(F.col("later_key").alias("later")).join(gone, "later", "left_anti"))
    n = still.count()
    if n:
        asked = send(marked(still, lambda part: np.asarray(part.column(0)), n, 2 * own.agg(F.sum("many")).first()[0]))
        words = send(marked(own.select("packed"), lambda part: np.concatenate([np.zeros(0, np.uint32), *(c.tokens[np.repeat(asked.value.has(c.heads["key"]), c.heads["prefix"])] for c in _each([part]))]), 16 * n, int(many.sum()) // 16))
        rest = all_candidates(postings(own, splits, blocks, asked, words))
        rest = cut(rest.join(still.withColumnRenamed("later", "later_key"), "later_key", "left_semi").join(pairs, ["later_key", "earlier_key"], "left_anti"))
        more = verified(df, counts, loose, rest)
        drop(rest)
        gone = gone.unionAll(more)
    drop(found, still)
    kept = first_places(own).join(gone, F.col("key") == F.col("later"), "left_anti")
    kept = kept.groupBy(F.col("doc").alias("stay_doc"), F.col("tie").alias("stay_tie")).agg(F.collect_list(F.col("line").cast("long")).alias("stay"))
    return kept, loose.value is not None


def _with_kept(df: DataFrame, text: str, key: str) -> tuple[DataFrame, str, str]:
    """``df`` with a struct of the text without later matches and its numbers of lines, and whether a line with a word stays or none was there; their names clash with no column."""
    whole = F.col(text).cast("string")
    doc, tie = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(whole, F.lit("")))
    own = df.select(doc.alias("doc"), tie.alias("tie"), whole.alias("text"))
    names = {x: free_name(df, f"line_dedup_{x}") for x in ("result", "doc", "tie", "row", "n", "lines", "stay", "some")}
    stay, repeated = stays(own)
    stay = stay.select(F.col("stay_doc").alias(names["doc"]), F.col("stay_tie").alias(names["tie"]), F.col("stay").alias(names["stay"]))
    named = df.withColumns({names["row"]: F.monotonically_increasing_id(), names["doc"]: doc, names["tie"]: tie})
    joined = named.join(stay, [names["doc"], names["tie"]], "left")
    none = F.array().cast("array<long>")
    mine = F.coalesce(F.col(names["stay"]), none)
    if repeated:
        copies = named.groupBy(names["doc"], names["tie"]).agg(F.min(names["row"]).alias(names["n"]), F.count("*").alias(names["lines"])).where(F.col(names["lines"]) > 1).drop(names["lines"])
        joined = joined.join(copies, [names["doc"], names["tie"]], "left")
        mine = F.when(F.coalesce(F.col(names["n"]) == F.col(names["row"]), F.lit(True)), mine).otherwise(none)
    count = F.when(F.coalesce(whole, F.lit("")) == "", 0).otherwise(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    joined = joined.withColumns({names["stay"]: mine, names["some"]: F.size(mine) > 0, names["n"]: count})
    n, stay_at = F.col(names["n"]), F.col(names["stay"])
    joined = joined.withColumn(names["lines"], F.when((n > 0) & (F.size(stay_at) < n), F.split(whole, "\n")))
    joined = joined.withColumn(names["stay"], F.when(F.col(names["lines"]).isNotNull(), _staying(F.col(names["lines"]), stay_at, n)))
    changed = F.col(names["lines"]).isNotNull()
    left = F.array_join(F.transform(stay_at, lambda i: F.get(F.col(names["lines"]), i.cast("int"))), "\n")
    parts = F.struct(F.when(changed, left).otherwise(whole).alias("text"), n.alias("n_lines"), F.when(changed, n - F.size(stay_at)).otherwise(0).cast("long").alias("n_removed"))
    some = F.col(names["some"]) | ~F.coalesce(whole.rlike("[^ \\t-\\r]"), F.lit(False))
    return joined.withColumns({names["result"]: parts, names["some"]: some}).select(*[F.col(f"`{c}`") for c in df.columns], names["result"], names["some"]), names["result"], names["some"]


def _staying(lines: Column, stay: Column, n: Column) -> Column:
    """The numbers of the lines that stay, ascending: those given and those without a word."""
    wordless = F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: ~F.get(lines, i.cast("int")).rlike("[^ \t-\r]"))
    return F.array_sort(F.array_union(stay, wordless))


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_lines, n_removed): the texts without later matches; each removed line is a link to an earlier one."""
    out, name, _ = _with_kept(df.select(key, text), text, key)
    return out.select(key, F.col(f"{name}.text").alias(text), F.col(f"{name}.n_lines").alias("n_lines"), F.col(f"{name}.n_removed").alias("n_removed"))


def without_repeated_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with the texts without later matches, less the rows of which no line with a word is left."""
    out, name, some = _with_kept(df, text, key)
    return out.where(some).select(*[F.col(f"{name}.text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
