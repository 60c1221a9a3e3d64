"""Document fingerprints by a randomised edit embedding, compared by Hamming distance; bands and verification.

A walk reads a text character by character and writes one symbol a step: a hash of the step and of the character it
stands on. A random bit of step and character, the same for all texts, says whether the walk moves on. Two texts that
differ by few edits soon walk in step again, so the number of edits becomes a number of differing symbols. The
fingerprint samples 4-bit symbols at steps that are the same for all texts: so many from each octave of steps, hence
texts of any length compare. Likeness is the share of equal samples, each octave weighted by its steps, less what
chance gives. Bands are runs of sampled symbols; near documents agree in one and are verified by likeness, all members
of a band's bucket with each other.

All walks of a slice of a batch are made in lockstep, a step at a time over all texts that haven't ended.

Defined results: a null or empty text has an empty fingerprint, which is like an empty one only (likeness 1); equal
texts have equal fingerprints; the next document is the next row by doc_id, rows without one first, equal ones in the
order of their texts' hashes, and after the last the first, also if that is the row itself; repeated rows stay repeated; only
the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import STEP_BYTES, bounded_batches, cut, groups, mapped, mix, partitions
from .minhash_dedup import tiled

#: Steps after which the random bits repeat, classes of characters, the first octave (steps below go whole) and samples of each further one.
PERIOD, CLASSES, FIRST, SAMPLES = 4096, 256, 5, 32
#: Samples of a band, and the likeness from which texts count as near.
BAND, NEAR = 16, 0.5
#: Members of a bucket that are compared at once with as many others.
TILE = 1024
_MOVES = (mix(np.arange(PERIOD * CLASSES, dtype=np.uint64)) >> np.uint64(63)).astype(np.uint8).reshape(PERIOD, CLASSES)
_SYMBOLS = (mix(np.arange(PERIOD * CLASSES, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(60)).astype(np.uint8).reshape(PERIOD, CLASSES)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _sampled(octave: int) -> np.ndarray:
    """The sampled steps of [2^octave, 2^(octave + 1))."""
    if octave < FIRST:
        return np.arange(1 << octave, 2 << octave)
    chosen = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(octave << 20)) % np.uint64((1 << octave) // SAMPLES)
    return (1 << octave) + np.arange(SAMPLES) * ((1 << octave) // SAMPLES) + chosen.astype(np.int64)


_STEPS = np.concatenate([[0], *[_sampled(k) for k in range(40)]])
_WEIGHTS = np.concatenate([[1.0], *[np.full(len(_sampled(k)), (1 << k) / len(_sampled(k))) for k in range(40)]])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[np.ndarray]) -> list[str]:
    """Hex digits of the sampled symbols of each text's walk, given as code points; the walk ends with the text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    live = order[: int((sizes > 0).sum())]
    if not len(live):
        return [""] * len(texts)
    classes = (np.concatenate([texts[i] for i in live]) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)
    at = np.cumsum(sizes[live]) - sizes[live]
    stop = at + sizes[live]
    classes = np.concatenate([classes, np.zeros(16, np.int64)])  # ended walks go on into what follows until they are put aside
    found: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    step, k, sampled = 0, 0, int(_STEPS[0])
    who = live
    while len(who):
        if step == sampled or step & 15 == 0 or len(who) < 64:
            on = at < stop
            if not on.all():
                at, stop, who = at[on], stop[on], who[on]
        here = classes[at]
        row = step % PERIOD
        if step == sampled:
            found.append(_HEX[_SYMBOLS[row][here]])
            owners.append(who)
            k += 1
            sampled = int(_STEPS[k])
        at = at + _MOVES[row][here]
        step += 1
    symbols, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    symbols, owner = symbols[order].tobytes().decode(), owner[order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return [symbols[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def likeness(a: str, b: str) -> float:
    """0 to 1: the weighted share of equal samples, less the sixteenth that chance gives."""
    if a == b:
        return 1.0
    n, most = min(len(a), len(b)), max(len(a), len(b))
    same = np.frombuffer(a[:n].encode(), np.uint8) == np.frombuffer(b[:n].encode(), np.uint8)
    share = float(_WEIGHTS[:n][same].sum() / _WEIGHTS[:most].sum())
    return max(0.0, min(1.0, (share - 1 / 16) / (1 - 1 / 16)))


def bands(fingerprint: str, size: int = BAND) -> list[str]:
    """Names of the whole bands of a fingerprint: place and symbols; one with fewer symbols than a band is one band."""
    if 0 < len(fingerprint) < size:
        return [f"0:{fingerprint}"]
    return [f"{i}:{fingerprint[i : i + size]}" for i in range(0, len(fingerprint) - size + 1, size)]


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of characters replaced by the first as many of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


class Runs:
    """Runs of rows in the order of (doc_id, hash of the text), nulls first; a doc_id with many rows, or none, has runs of its own, by hash."""

    def __init__(self, cuts: list[int], nulls: int):
        """``cuts`` are quantiles of doc_id, a frequent one repeated; ``nulls`` is how many runs the rows without one get."""
        self.values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.nulls = nulls
        self.own = np.where(times > 1, times, 0)  # runs that hold one doc_id only
        self.start = nulls + 1 + np.arange(len(times)) + np.cumsum(self.own) - self.own

    def of(self, docs: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The run of each row."""
        spread = (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        out = (spread * np.uint64(max(1, self.nulls)) >> np.uint64(32)).astype(np.int64)
        last = np.searchsorted(self.values, docs, side="right") - 1
        if not len(self.values):
            return np.where(null, out, self.nulls)
        at = np.maximum(last, 0)
        among = np.where(self.values[at] == docs, (spread * self.own[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64), self.own[at])
        return np.where(null, out, np.where(last < 0, self.nulls, self.start[at] + among))


def dealt(df: DataFrame, many: int) -> DataFrame:
    """(part, seq, doc_id, hash, text): rows in runs of doc_id and hash, each run also holding the first row of the next, with seq 1.

    Runs are cut at quantiles of doc_id; equal rows are in one run. The last run ends with the first run's first row,
    with seq 2. The driver gets one row a run.
    """
    spark = df.sparkSession
    known = df.where("doc_id IS NOT NULL")
    cuts = known.approxQuantile("doc_id", [i / many for i in range(1, many)], 1 / (4 * many)) if many > 1 else []
    size = df.agg(F.count("*").alias("all"), F.count("doc_id").alias("known")).first()
    nulls = -(-many * (size["all"] - size["known"]) // max(1, size["all"]))
    runs = spark.sparkContext.broadcast(Runs([int(x) for x in cuts], nulls))

    @F.pandas_udf("int")
    def run_of(docs: pd.Series, null: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(runs.value.of(docs.to_numpy(np.int64), null.to_numpy(bool), hashes.to_numpy(np.int64)).astype(np.int32))

    bounded_batches(spark)
    hashed = df.withColumn("hash", F.xxhash64("text"))
    placed = hashed.withColumn("part", run_of(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), "hash"))
    heads = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash")).alias("head")).orderBy("part").collect()  # one row for each run
    parts = [r["part"] for r in heads]
    copies = [(r["head"]["doc_id"], r["head"]["hash"], *((parts[-1], 2) if at == 0 else (parts[at - 1], 1))) for at, r in enumerate(heads)]
    ends = F.broadcast(spark.createDataFrame(copies, "head_doc long, head_hash long, to int, seq int"))  # as many rows as there are runs
    joined = placed.join(ends, F.col("doc_id").eqNullSafe(F.col("head_doc")) & (F.col("hash") == F.col("head_hash")), "left")
    copy = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), "seq"))
    places = F.array_compact(F.array(F.struct(F.col("part"), F.lit(0).alias("seq")), copy))
    return joined.withColumn("place", F.explode(places)).select("place.part", "place.seq", "doc_id", "hash", "text").repartition(partitions(spark), "part")


def with_fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", runs: int | None = None) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, band_hits_edited, band_hits_next) of every row.

    ``near_*`` are likenesses; ``band_hits_*`` count the bands shared with the edited and with the next text.
    """
    bounded_batches(df.sparkSession)
    own = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sorted_runs = dealt(own, runs or 4 * partitions(df.sparkSession)).sortWithinPartitions("part", "seq", F.col("doc_id").asc_nulls_first(), "hash").drop("hash")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "band_hits_edited", "band_hits_next"]
    ddl = f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, band_hits_edited int, band_hits_next int"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]

    def rows(held: list[tuple]) -> pa.RecordBatch:
        """Results of all held rows but the last, which is the next of the one before."""
        texts = [x[3] for x in held]
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
        prints = fingerprints([code_points(x) for x in [*texts, *changed]])
        own, other = prints[: len(texts)], prints[len(texts) :]
        out: list[list] = [[] for _ in names]
        for i, (_, seq, doc_id, value) in enumerate(held[:-1]):
            if seq or held[i + 1][0] != held[i][0]:
                continue
            mine = set(bands(own[i]))
            for column, x in zip(out, (doc_id, len(value), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(), own[i], other[i], likeness(own[i], other[i]), likeness(own[i], own[i + 1]), len(mine.intersection(bands(other[i]))), len(mine.intersection(bands(own[i + 1]))))):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and row[0] == held[-1][0] and row[1] and held[-1][1] == row[1]:
                    continue  # a repeated head: its first copy is the next of the run's last
                held.append(row)
                size += len(row[3])
                if size > 8 * STEP_BYTES and len(held) > 1:
                    yield rows(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield rows(held)

    return mapped(sorted_runs, run, ddl)


def _near(prints: list[str], least: float) -> list[tuple[int, int, float]]:
    """Pairs of fingerprints, as indexes, that are alike by ``least``, with their likeness."""
    sizes = np.array([len(x) for x in prints])
    symbols = np.zeros((len(prints), int(sizes.max())), np.uint8)
    for i, x in enumerate(prints):
        symbols[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)
    weights, total = _WEIGHTS[: symbols.shape[1]], np.cumsum(_WEIGHTS)
    out = []
    for i in range(len(prints) - 1):
        same = (symbols[i + 1 :, : sizes[i]] == symbols[i, : sizes[i]]) @ weights[: sizes[i]]
        share = same / total[np.maximum(sizes[i], sizes[i + 1 :]) - 1]
        for j in (np.flatnonzero((share - 1 / 16) / (1 - 1 / 16) >= least - 1e-6) + i + 1).tolist():
            like = likeness(prints[i], prints[j])
            if like >= least:
                out.append((i, j, like))
    return out


def near_pairs(prints: DataFrame, key: str = "doc_id", fingerprint: str = "fingerprint", least: float = NEAR) -> DataFrame:
    """(a, b, likeness): all pairs of rows, a before b by their key, that share a band and are alike by ``least``.

    All members of a band's bucket are compared, a large bucket's in pairs of tiles of bounded size, each pair of tiles
    by itself. Rows without a key or with an empty fingerprint are in no pair.
    """
    spark = prints.sparkSession
    bounded_batches(spark)

    @F.pandas_udf("array<string>")
    def names(prints: pd.Series) -> pd.Series:
        return prints.map(bands)

    rows = prints.select(F.col(key).cast("long").alias("node"), F.col(fingerprint).alias("print")).where("node IS NOT NULL AND print != ''").distinct()
    held = cut(rows.withColumn("band", F.explode(names("print"))).withColumn("band", F.xxhash64("band")))
    sizes = cut(held.groupBy("band").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.count("*").alias("size")).where("size > 1").drop("size"))
    dealt = tiled(held, "band", "node", sizes).repartition(partitions(spark), "band", "pair").sortWithinPartitions("band", "pair", "node").select("band", "pair", "node", "print")
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64())]

    def run(batches):
        for parts in groups(batches, 2):
            nodes = np.concatenate([np.asarray(p.column(2)) for p in parts])
            found = _near([x for p in parts for x in p.column(3).to_pylist()], least)
            rows = [(int(nodes[i]), int(nodes[j]), like) for i, j, like in found if nodes[i] < nodes[j]]
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows[k : k + 50_000]), kinds)], schema=pa.schema(kinds))

    return mapped(dealt, run, "a long, b long, likeness double").distinct()
