"""Toxicity: a convolutional text classifier in numpy, and thresholds calibrated by language.

A word's embedding is the sum of three hashed rows: of the word, of its first 4 bytes and of its first 6. Filters one,
two and three words wide run over the embeddings; the largest value of each filter over the whole document goes through
a linear layer to a logit. It is trained with the gradient of the largest values only, by Adagrad in the driver, on a
sample of labelled rows of bounded size (SAMPLE, a parameter). A third of the sample gives the starting value of one
embedding dimension (how much a bucket's presence speaks for the label), the rest the gradients and the calibration. In
the end the logit is scaled so that the threshold of the best F1 falls on 0.3; each language with enough labelled rows
gets its own threshold beside it. Scores never see the language.

Defined results: a null or empty text has the score of a document without words; with no labelled rows, or only one
kind of label, every score is 0; repeated rows stay repeated; a null key passes through, counts as not held out and is
not learned from; a document labelled more than once has its highest label; only the named columns are read; an empty
table gives no rows. Every text is scored whole; labelled texts of more than LONGEST words aren't learned from.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, flat, free_name, in_arrow, lowered, slices, span_hashes, tidy, word_spans
from .language_id import fold

#: Labelled rows to learn from: of label 1 and of label 0 at most; words of one of them at most.
SAMPLE, LONGEST = (3000, 5000), 20_000
BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY, CUT = 12, 128, 0.05, 1e-4, 0.3

_BREAKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Odd factors that keep the buckets of words, short and long beginnings apart.
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SLOTS = [(k, j) for k in range(len(WIDTHS)) for j in range(WIDTHS[k])]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets of each word (words x 3) of all rows, and the rows' offsets in words."""
    data, offsets = flat(texts)
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets, _BREAKS)
    hashes = span_hashes(data, starts, ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 6))
    return np.stack([((h * odd) >> np.uint64(40)).astype(np.int64) % BUCKETS for h, odd in zip(hashes, _ODD)], axis=1).reshape(-1, 3), first


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray  # slots x dimensions x FILTERS
    bias: np.ndarray  # filters
    weights: np.ndarray
    offset: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        """What each bucket adds to each filter at each slot (buckets x slots x FILTERS)."""
        return np.einsum("bd,sdf->bsf", self.embedding, self.filters).reshape(BUCKETS, -1).astype(np.float32)

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def _pooled(slots: np.ndarray, first: np.ndarray, bias: np.ndarray, where: bool = False):
    """Largest value of each filter over each row's words (0 at least), from the words' parts (words x slots x FILTERS); if asked for, the places too."""
    n, rows = len(slots), len(first) - 1
    out = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32)
    places = np.full(out.shape, -1, np.int64)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    if not len(full):
        return (out, places) if where else out
    last = np.repeat(first[1:], sizes) - 1
    at = np.arange(n)
    for k, width in enumerate(WIDTHS):
        value = None
        for j in range(width):
            part = slots[:, _SLOTS.index((k, j)), :]
            if j:
                moved = np.zeros_like(part)
                moved[: n - j] = part[j:]
                moved[at + j > last] = 0
                part = moved
            value = part if value is None else value + part
        value = value + bias[k * FILTERS : (k + 1) * FILTERS]
        best = np.maximum.reduceat(value, first[full], axis=0)
        out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
        if where:
            hit = value == np.repeat(best, sizes[full], axis=0)
            for f in range(FILTERS):
                spots = np.where(hit[:, f], at, n)
                found = np.minimum.reduceat(spots, first[full])
                places[full, k * FILTERS + f] = np.where(best[:, f] > 0, found, -1)
    return (out, places) if where else out


def logits(model: Model, table: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    slots = (table[words[:, 0]] + table[words[:, 1]] + table[words[:, 2]]).reshape(len(words), len(_SLOTS), FILTERS)
    return _pooled(slots, first, model.bias) @ model.weights + model.offset


def _evidence(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of label 1 for documents that hold a bucket."""
    held = np.zeros((2, BUCKETS))
    for words, y in zip(rows, labels):
        held[int(y), np.unique(words)] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    rate = n[1] / n.sum()
    total = held.sum(axis=0)
    return np.log(((held[1] + 4 * rate) / (total + 4)) / rate) - np.log(((held[0] + 4 * (1 - rate)) / (total + 4)) / (1 - rate))


def _gather(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros((0, 3), np.int64), *rows], dtype=np.int64), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


def train(rows: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Model | None:
    """Fit on documents given as word buckets; None where one kind of label only is there."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return None
    draw = np.random.default_rng(seed)
    lot = draw.permutation(len(rows))
    third = max(1, len(rows) // 3)
    early, late, judge = lot[:third], lot[third:], lot[third : third + max(1, len(rows) // 4)]
    if len(set(labels[early].tolist())) < 2:
        early = lot
    fit = np.setdiff1d(late, judge) if len(late) > 400 else late
    if len(set(labels[fit].tolist())) < 2 or len(set(labels[judge].tolist())) < 2:
        fit = judge = lot
    m = Model((draw.normal(0, 0.05, (BUCKETS, DIMENSIONS))).astype(np.float32), draw.normal(0, 0.15, (len(_SLOTS), DIMENSIONS, FILTERS)).astype(np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.3, np.float32))
    m.embedding[:, 0] = np.clip(_evidence([rows[i] for i in early], labels[early]), -3, 3) / 3
    m.filters[:, 0, :] = np.abs(m.filters[:, 0, :]) + 0.3
    m.weights *= np.where(draw.random(len(m.weights)) < 0.85, 1, -1)
    m.offset = float(np.log(labels[fit].mean() / (1 - labels[fit].mean())))
    sums = {name: np.full(np.shape(getattr(m, name)), 1e-2, np.float32) for name in ("embedding", "filters", "bias", "weights", "offset")}
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(mixed := draw.permutation(fit), max(1, len(mixed) // BATCH)):
            words, first = _gather([rows[i] for i in batch])
            vectors = m.embedding[words].sum(axis=1)
            slots = np.einsum("nd,sdf->nsf", vectors, m.filters, optimize=True)
            pooled, places = _pooled(slots, first, m.bias, where=True)
            error = 1 / (1 + np.exp(-(pooled @ m.weights + m.offset))) - labels[batch]
            weight = np.where(labels[batch] == 1, 1.5, 1.0) / len(batch)
            error = (error * weight).astype(np.float32)
            grads = {"weights": pooled.T @ error + DECAY * m.weights, "offset": error.sum(), "bias": np.zeros_like(m.bias), "filters": DECAY * m.filters, "embedding": None}
            down = np.where(places >= 0, error[:, None] * m.weights[None, :], 0)
            grads["bias"] = down.sum(axis=0)
            end = np.repeat(first[1:], 1)
            spots, pushes = [], []
            for s, (k, j) in enumerate(_SLOTS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                at = places[:, own] + j
                real = (places[:, own] >= 0) & (at < end[:, None])
                d, f = np.nonzero(real)
                g = down[:, own][d, f]
                for one in range(FILTERS):
                    mine = f == one
                    grads["filters"][s, :, one] += vectors[at[d, f][mine]].T @ g[mine]
                spots.append(at[d, f])
                pushes.append(g[:, None] * m.filters[s].T[f])
            spots, pushes = np.concatenate(spots), np.concatenate(pushes)
            touched, which = np.unique(words[spots].ravel(), return_inverse=True)
            grad = np.zeros((len(touched), DIMENSIONS), np.float32)
            np.add.at(grad, which, np.repeat(pushes, 3, axis=0))
            sums["embedding"][touched] += grad**2
            m.embedding[touched] -= rate * grad / np.sqrt(sums["embedding"][touched])
            for name in ("weights", "offset", "bias", "filters"):
                sums[name] = sums[name] + grads[name] ** 2
                setattr(m, name, getattr(m, name) - rate * grads[name] / np.sqrt(sums[name]))
    m.offset = float(m.offset)
    table, judged = m.table(), []
    for batch in np.array_split(judge, max(1, len(judge) // BATCH)):
        judged.append(logits(m, table, *_gather([rows[i] for i in batch])))
    _calibrate(m, np.concatenate(judged), labels[judge], [langs[i] for i in judge])
    return m


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the lowest logit of those that give the best F1."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1
    k = int(f1.argmax())
    low = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    return float((z[order][k] + low) / 2)


def _calibrate(m: Model, z: np.ndarray, y: np.ndarray, langs: list[str | None]) -> None:
    cut = _best_cut(z, y)
    spread = float(np.std(z)) or 1.0
    m.scale = 2.0 / spread
    m.shift = float(np.log(CUT / (1 - CUT))) - m.scale * cut
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.fromiter((x == lang for x in langs), bool, len(langs))
        if y[mine].sum() >= 20 and (1 - y[mine]).sum() >= 20:
            m.thresholds[lang] = float(m.score(np.array([_best_cut(z[mine], y[mine])]))[0])


def sample(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE, text: str = "text", key: str = "doc_id", label: str = "toxic") -> tuple[list[np.ndarray], np.ndarray, list]:
    """Word buckets, labels and languages of the rows to learn from: those whose keys have the lowest hashes, of each label so many."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~fold(F.col(key), 4, 2)).groupBy(F.col(key).cast("long").alias("own_key")).agg(F.max(F.col(label).cast("int")).alias("own_label"))
    parts = [known.where(F.col("own_label") == y).orderBy(F.xxhash64("own_key"), "own_key").limit(n) for y, n in zip((1, 0), most)]
    chosen = docs.select(F.col(key).cast("long").alias("own_key"), F.col(text).cast("string").alias("text"), (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")).join(F.broadcast(parts[0].unionAll(parts[1])), "own_key")  # sum(most) rows at most

    def step(part: pa.RecordBatch) -> dict:
        words, first = features(part.column(1))
        return {"own_key": part.column(0), "own_label": part.column(3), "lang": part.column(2), "words": [words[a:b].astype(np.uint16).tobytes() if b - a <= LONGEST else None for a, b in zip(first[:-1], first[1:])]}

    rows = in_arrow(chosen.select("own_key", "text", "lang", "own_label"), step, "own_key long, own_label int, lang string, words binary").toPandas()
    rows = rows[rows["words"].notna()].sort_values(["own_key", "words"]).drop_duplicates("own_key")
    return [np.frombuffer(x, np.uint16).reshape(-1, 3) for x in rows["words"]], rows["own_label"].to_numpy(), [None if x is None else str(x) for x in rows["lang"]]


def learn(docs: DataFrame, labels: DataFrame, **names) -> Model | None:
    return train(*sample(docs, labels, **names))


def score(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang, score, threshold, toxic): ``toxic`` goes by the threshold of the row's language, 0.3 where it has none."""
    if model is not None:
        shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))
    lang = (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string")

    def step(part: pa.RecordBatch) -> dict:
        if model is None:
            found = np.zeros(part.num_rows)
        else:
            own, table = shared.value
            found = own.score(logits(own, table, *features(part.column(1)))).astype(np.float64)
        return {key: part.column(0), "lang": part.column(2), "score": found}

    thresholds = model.thresholds if model else {}
    limit = F.lit(CUT)
    for name, value in thresholds.items():
        limit = F.when(F.col("lang") == name, F.lit(value)).otherwise(limit)
    found = in_arrow(docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"), lang.alias("lang")), step, f"{key} long, lang string, score double")
    return found.withColumn("threshold", limit).withColumn("toxic", (F.col("score") >= F.col("threshold")).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted, threshold, toxic), learned from the labelled rows that are not held out."""
    found = score(docs, learn(docs, labels, text=text, key=key), text, key)
    return found.select(F.col(key), fold(F.col(key), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "toxic")


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows whose score stays below the threshold of their language; all rows if nothing could be learned."""
    model = learn(docs, labels, text=text, key=key)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own, table = shared.value
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
        found = [own.score(logits(own, table, *features(part.column(0)))) for part in slices(batch, "text")]
        tidy()
        return pd.Series(np.concatenate([np.zeros(0), *found]))

    bounded_batches(docs.sparkSession)
    name = free_name(docs, "scored")
    limit = F.lit(CUT)
    if "lang" in docs.columns:
        for lang, value in model.thresholds.items():
            limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    has_text = F.coalesce(F.trim(F.col(text)) != "", F.lit(False))
    return docs.withColumn(name, scored(F.col(text).cast("string"))).where(~has_text | (F.col(name) < limit)).drop(name)
