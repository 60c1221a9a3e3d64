"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods of a document's segments.

Training counts hashed 4-byte grams of every labelled row of the MOST_LANGUAGES most frequent languages in the
executors; the driver gets one packed row of counts a language. A document's grams are cut into segments of 64; each segment has a likelihood under each
language, and expectation-maximisation gives the languages' proportions. Sets of the 1, 2, ... most likely languages
are compared by their likelihood less a penalty for each language, up to all languages or until the penalty alone is
more than the best set's loss; the best set's largest proportion is the answer.

Defined results: ``und`` with score 0 for a null text, one without a letter, or if nothing could be learned; ties go to
the language that sorts first; repeated rows stay repeated; a null key passes through, counts as not held out and is
not learned from; only the named columns are read; an empty table gives no rows. Long texts are read whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, flat, free_name, in_arrow, mapped, partitions, slices, tidy

#: Gram buckets, grams of a segment, EM steps; a gram's share of independent evidence, and the cost of a language.
BUCKETS, SEGMENT, STEPS, SHARE, PENALTY = 1 << 16, 64, 12, 0.25, 4.0
UNDEFINED = "und"
#: Languages that are learned: those with most labelled rows, by name where counts tie. This bounds the model, not the rows.
MOST_LANGUAGES = 400

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
_FOLD[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 4-byte grams of all rows, letters only, one space before and three after each row; and the rows' offsets."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + 4 * rows, 32, np.uint8)
    padded[np.arange(len(data)) + 4 * np.repeat(np.arange(rows), np.diff(offsets)) + 1] = _FOLD[data]
    x = padded.astype(np.uint32)
    code = np.zeros(max(0, len(x)), np.uint32)
    code[: len(x) - 3] = (x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))) * np.uint32(2654435761) >> np.uint32(16)
    sizes = np.diff(offsets) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.arange(int(bounds[-1])) + 3 * np.repeat(np.arange(rows), sizes)
    return code[keep], bounds


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.fromiter((x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()), bool, len(texts))


def count_grams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, counts): of each language one row, with the packed counts of its gram buckets over all rows."""
    bounded_batches(df.sparkSession)

    def rows(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([zlib.compress(n.tobytes(), 1) for n in counts.values()], pa.binary())], names=["lang", "counts"])

    def first(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column(0).to_pylist()
                codes, bounds = grams(*flat(part.column(1)))
                for name in set(langs):
                    mine = np.repeat(np.fromiter((x == name for x in langs), bool, len(langs)), np.diff(bounds))
                    counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    counts[name] += np.bincount(codes[mine], minlength=BUCKETS)
        yield rows(counts)

    def second(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[name] = counts.get(name, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
        yield rows(counts)

    ddl = "lang string, counts binary"
    partial = mapped(df.select(F.col(lang).alias("lang"), F.col(text).alias("text")), first, ddl)
    return mapped(partial.repartition(partitions(df.sparkSession), "lang"), second, ddl)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and their log-probabilities of the buckets (BUCKETS x languages), from rows with a language and a text."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    frequent = labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MOST_LANGUAGES).collect()
    names = sorted(r[lang] for r in frequent)
    table = np.full((BUCKETS, len(names)), 0.5, np.float32)
    total = np.zeros(len(names))
    if names:
        at = {name: i for i, name in enumerate(names)}
        for r in count_grams(labelled.where(F.col(lang).isin(names)), text, lang).toLocalIterator():  # a row a language
            counts = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
            total[at[r["lang"]]] = counts.sum()
            table[:, at[r["lang"]]] += counts
    return names, (np.log(table) - np.log(total + 0.5 * BUCKETS)).astype(np.float32) if names else table


def _em(like: np.ndarray, first: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) and log-likelihoods of the rows, from the segments' likelihoods and the languages allowed for each row."""
    weights = allowed / allowed.sum(axis=1, keepdims=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(STEPS):
        shares = like * weights[row]
        total = np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
        weights = np.add.reduceat(shares / total, first, axis=0) / sizes[:, None]
    return weights, np.add.reduceat(np.log(np.maximum((like * weights[row]).sum(axis=1), 1e-300)), first)


def mixtures(codes: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages of each row, and the probability of its single most likely language."""
    sizes = -(-np.diff(bounds) // SEGMENT)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = bounds[row] + (np.arange(len(row)) - first[row]) * SEGMENT
    logs = np.add.reduceat(table[codes], starts, axis=0).astype(np.float64) * SHARE
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)
    weights, _ = _em(like, first, sizes, np.ones((len(sizes), table.shape[1])))
    order = np.argsort(-weights, axis=1, kind="stable")
    best, chosen = np.full(len(sizes), -np.inf), weights
    for k in range(1, table.shape[1] + 1):
        cost = PENALTY * k + 0.5 * k * np.log(np.maximum(sizes, 1))
        still = best < -cost  # a set's log-likelihood is at most 0, and the cost grows with it
        if not still.any():
            break
        allowed = np.zeros((int(still.sum()), table.shape[1]))
        np.put_along_axis(allowed, order[still, :k], 1.0, axis=1)
        mine, fit = _em(like[still[row]], np.cumsum(sizes[still]) - sizes[still], sizes[still], allowed)
        fit = fit - cost[still]
        better = fit > best[still]
        at = np.flatnonzero(still)[better]
        chosen[at], best[at] = mine[better], fit[better]
    whole = np.add.reduceat(logs, first, axis=0)
    whole = np.exp(whole - whole.max(axis=1, keepdims=True))
    return chosen, whole / whole.sum(axis=1, keepdims=True)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, languages): ``languages`` lists those chosen with their proportions."""
    names, table = model
    shared = df.sparkSession.sparkContext.broadcast(table)

    def step(part: pa.RecordBatch) -> dict:
        pred, score, mix, _ = _predicted(part.column(1), names, shared.value)
        return {key: part.column(0), "lang_pred": pred, "score": score, "languages": mix}

    return in_arrow(df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")), step, f"{key} long, lang_pred string, score double, languages string")


def _predicted(texts: pa.Array, names: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """The language, its score, the chosen languages with their proportions, and the language's own proportion, of each text."""
    known = has_letter(texts) & bool(names)
    pred, score, mix, share = [UNDEFINED] * len(known), np.zeros(len(known)), [""] * len(known), np.zeros(len(known))
    at = 0
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        mine = known[at : at + part.num_rows]
        if mine.any():
            chosen, alone = mixtures(*grams(*flat(part.column(0).filter(pa.array(mine)))), table)
            for i, w, p in zip((np.flatnonzero(mine) + at).tolist(), chosen, alone):
                k = int(w.argmax())
                pred[i], score[i], share[i] = names[k], float(min(1.0, w[k] * max(p[k], w[k]))), w[k]
                mix[i] = ",".join(f"{names[j]}:{w[j]:.2f}" for j in np.argsort(-w, kind="stable") if w[j] >= 0.005)
        at += part.num_rows
    return pred, score, mix, share


def attached(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with a struct column of the language and its share for each row's text, named so that it clashes with none."""
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<lang_pred:string,share:double>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        pred, _, _, share = _predicted(pa.array(texts, pa.string(), from_pandas=True), names, shared.value)
        tidy()
        return pd.DataFrame({"lang_pred": pred, "share": share})

    bounded_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "judged"), judged(F.col(text).cast("string")))


def keep_identified(docs: DataFrame, least: float, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text has a letter and of which some learned language makes up ``least``; all with a letter if none was learned.

    All rows with a language are learned from: none is held out, as nothing is measured here.
    """
    model = learn(docs, text, lang)
    if not model[0]:
        return docs.where(F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))
    out = attached(docs, model, text)
    name = (set(out.columns) - set(docs.columns)).pop()
    return out.where((F.col(f"{name}.lang_pred") != UNDEFINED) & (F.col(f"{name}.share") >= least)).drop(name)


def fold(key: Column, folds: int, held: int) -> Column:
    """Whether a row is held out: the CRC-32 of its key as text, modulo ``folds``, is ``held``."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == held, F.lit(False))


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score, languages), learned from the rows that are not held out."""
    held = fold(F.col(key), 3, 1)
    model = learn(df.where(F.col(key).isNotNull() & ~held), text, lang)
    return predict(df, model, text, key).select(F.col(key), fold(F.col(key), 3, 1).alias("held_out"), "lang_pred", "score", "languages")
