"""Best-fit packing planned on a histogram of lengths; documents take the planned slots by their rank within a length.

Documents are tokenized once and cut into pieces of at most ``capacity`` ids; each piece is numbered among those of its
length within its task. Only the histogram (a count for each of at most ``capacity`` lengths) goes to the driver. The
plan is best-fit decreasing over counts: all pieces of a length, longest first, go to the open sequences with the
smallest room that holds them, whole groups of equal sequences at a time. Its size depends on ``capacity``, not on the
corpus, and so does what is broadcast: runs of ranks, each with its first sequence and place. A piece's rank within its
length is its number in its task plus what the tasks before have of that length; the run holding that rank gives its
sequence and offset.

Defined results: a null or empty text is one piece that holds the end id only; repeated rows are packed each; a null
key passes through; an empty table gives no rows; only the named columns are read. Words between ASCII white space are
encoded one by one and cached, which gives the ids of the whole text, as the tokenizer drops white space. A text's ids
are held in memory together with those of its slice of the batch.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import bounded_batches, cut, flat, lowered, mapped, slices, span_hashes, word_spans

CAPACITY, END_ID, CACHED_WORDS = 2048, 0, 400_000

#: Kinds of bytes: 0 white space and beyond ASCII, 1 letters, 2 other ASCII. Second bytes of Latin-1 letters. What keeps a word whole.
_KIND = np.array([1 if i < 128 and chr(i).isalpha() else 2 if i < 128 and i != 32 and not 9 <= i <= 13 else 0 for i in range(256)], np.uint8)
_LATIN = np.array([128 <= i < 192 and i not in (0x97, 0xB7) for i in range(256)])
_WHOLE = np.array([i in b"'<" for i in range(256)])


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of text that the tokenizer encodes independently of what surrounds them.

    Text is parted by ASCII white space, and between a letter (of ASCII or Latin-1) and another ASCII character, save in
    words with an apostrophe (contractions) or ``<`` (special tokens). A-Z is lower-cased but where ``<`` stands. Gives
    the bytes, the spans' starts and ends, each row's first span, and which spans hold nothing but letters.
    """
    starts, ends, _ = word_spans(data, offsets)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = 1
    with_mark = np.concatenate([[0], np.cumsum(_WHOLE[data])])
    whole = with_mark[ends] > with_mark[starts]
    split = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
    word = np.searchsorted(starts, split, side="right") - 1
    inside = (word >= 0) & (split < ends[word]) & (split > starts[word]) & ~whole[word] if len(starts) else np.zeros(len(split), bool)
    low = lowered(data)
    for i in np.flatnonzero(whole):
        if 60 in data[starts[i] : ends[i]]:
            low[starts[i] : ends[i]] = data[starts[i] : ends[i]]
    starts, ends = np.sort(np.concatenate([starts, split[inside]])), np.sort(np.concatenate([ends, split[inside]]))
    letters = np.concatenate([[0], np.cumsum(kind == 1)])
    return low, starts, ends, np.searchsorted(starts, offsets), letters[ends] - letters[starts] == ends - starts


class WordIds:
    """Token ids of words, from a cache of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.starts, self.sizes, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _encoded(self, new: list[bytes], plain: np.ndarray) -> list[np.ndarray]:
        """Ids of words; plain ones, of letters only, make one run of tokens each, whose last token ends a word."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found: list = [None] * len(new)
        at = np.flatnonzero(plain)
        for i in range(0, len(at), 1024):
            mine = at[i : i + 1024].tolist()
            ids = np.asarray(encode([b" ".join([new[k] for k in mine]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(mine):
                plain[mine] = False
                continue
            for k, a, b in zip(mine, [0, *ends[:-1].tolist()], ends.tolist()):
                found[k] = ids[a:b]
        rest = np.flatnonzero(~plain).tolist()
        for k, x in zip(rest, encode([new[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)):
            found[k] = np.asarray(x.ids, np.uint32)
        return found

    def _add(self, new: list[bytes], plain: np.ndarray) -> None:
        found = self._encoded(new, plain)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.places)
        for name, need in (("starts", at + len(new)), ("sizes", at + len(new)), ("pool", self.used + int(sizes.sum()))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old)), old.dtype)]))
        self.sizes[at : at + len(new)] = sizes
        self.starts[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + int(sizes.sum())] = np.concatenate(found) if found else []
        self.used += int(sizes.sum())
        for i, w in enumerate(new):
            self.places[w] = at + i

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, each row's with END_ID after them, and the rows' offsets."""
        data, starts, ends, first, plain = word_parts(data, offsets)
        _, at, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(self.places) > CACHED_WORDS:
            self.clear()
        place = np.fromiter(map(self.places.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.places) + np.arange(len(new))
            self._add([distinct[k] for k in new.tolist()], plain[at][new])
        place = place[which]
        sizes, rows = self.sizes[place], len(offsets) - 1
        before = np.concatenate([[0], np.cumsum(sizes)])
        bounds = before[first] + np.arange(rows + 1)
        out = np.full(int(bounds[-1]), END_ID, np.uint32)
        total = int(before[-1])
        if total:
            row_of_word = np.repeat(np.arange(rows), np.diff(first))
            target = np.arange(total) + np.repeat(row_of_word, sizes)
            out[target] = self.pool[np.repeat(self.starts[place] - before[:-1], sizes) + np.arange(total)]
        return out, bounds


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, place): place numbers the pieces of a length within task ``part``."""
    bounded_batches(df.sparkSession)
    kinds = [(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = word_ids(path).ids(*flat(part.column(1)))
                counts = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(len(counts)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[row] - start, capacity)
                a = bounds[row] + start
                view = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist())]
                order = np.argsort(length, kind="stable")
                sizes, firsts, many = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.repeat(firsts, many) + np.repeat(seen[sizes], many)
                seen[sizes] += many
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(x, kind) for x, (_, kind) in zip([piece, start, length, sums, np.full(len(row), task), place], kinds[1:]))], schema=schema)
        word_ids(path).clear()

    return mapped(df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")), run, f"{key} long, piece int, start long, length long, ids_crc32 long, part int, place long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, ranks, first sequence, pieces a sequence, offset).

    Rank r of a run goes to its first sequence + (r - first rank) // pieces a sequence, at its offset + length times
    the remainder.
    """
    runs, room, sequences = [], {}, 0  # room: free ids -> groups (first sequence, sequences)
    order: list[int] = []  # the keys of room, ascending

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            if free not in room:
                bisect.insort(order, free)
            room.setdefault(free, []).append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence of {capacity} holds a piece of {length}")
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                free = order[k]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], order[k]
            else:
                free, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = free // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - free))
                put(free - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                runs.append((length, rank, left, first, left, capacity - free))
                put(free - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(free, first, n)
    return runs


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = df.sparkSession
    cutted = cut(pieces(df, path, capacity, text, key))
    held = cutted.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(F.col("part").alias("in_part"), F.col("length").alias("of_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cutted.join(before, (F.col("part") == F.col("in_part")) & (F.col("length") == F.col("of_length"))).select(key, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    runs = np.asarray(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def take(batches):
        runs = shared.value
        first = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            run = runs[np.searchsorted(first, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + nth // run[:, 4], pa.int64()), pa.array(run[:, 5] + nth % run[:, 4] * length, pa.int64())], names=names)

    return mapped(ranked, take, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
