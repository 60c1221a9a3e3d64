"""The corpus pipeline: its stages one by one, and whole."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import corpus, plain_components, plain_language, plain_lines, plain_toxicity, rows, words

import corpus_pipeline
from folioforge.llm import language_id, toxicity

NAMES = ["language_id", "toxicity", "line_dedup", "near_dedup", "packing"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [x for x in corpus(80) if x[0] is not None]
    spark.createDataFrame([r[:5] for r in rows(texts)], schema).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_return_documents(spark, folder, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
        if name == "language_id":
            assert {r["doc_id"] for r in docs.where("doc_id >= 1000").collect()} == {1003, 1004, 1005, 1006, 1007, 1008}
        if name == "near_dedup":
            sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (words(r["text"]) for r in docs.collect() if r["doc_id"] != 1006) if w]
            assert not any(100 * len(a & b) >= 85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    for _, own in docs.toPandas().sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]


def test_run_against_plain_stages(spark, tmp_path_factory):
    """run() against the five stages in plain code, each over what the one before kept. The two models are those that the stages learn."""
    from tokenizers import Tokenizer

    out = str(tmp_path_factory.mktemp("plain"))
    draw = random.Random(8)
    texts = [(i, t) for i, t in corpus(60, seed=5) if i is not None and i != 1006 and len(t or "") < 20_000]
    for k in range(6):  # near copies that line dedup leaves, as their lines break elsewhere
        prose = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(91)]
        texts += [(2000 + 2 * k + j, "\n".join(" ".join(prose[a : a + width]) for a in range(0, 91, width))) for j, width in enumerate((7, 13))]
    nasty = {i: f"{t} nasty awful nasty" for i, t in texts if t and i % 5 == 0}
    texts = [(i, nasty.get(i, t)) for i, t in texts]
    labels = [(i, 0, int(i in nasty)) for i, _ in texts if draw.random() < 0.9]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], schema).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")

    frame_of = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    own = language_id.learn(frame_of([x for x in texts if zlib.crc32(str(x[0]).encode()) % 3 != 1]))
    texts = [x for x in texts if (found := plain_language(x[1], *own))[0] != "und" and found[2] >= 0.2]
    model = toxicity.learn(frame_of(texts), spark.read.parquet(f"{out}/labels.parquet"))
    limit = model.thresholds.get("en", 0.3)
    toxic = {i for i, t in texts if plain_toxicity(model, toxicity.features(pa.array([t]))[0].tolist()) >= limit}
    assert len(toxic & set(nasty)) > 0.8 * len({i for i, _ in texts} & set(nasty)) and len(toxic) < len(nasty) + 5
    texts = [x for x in texts if x[0] not in toxic]
    texts = [(o[1], t) for o, t in plain_lines(texts) if t.strip()]
    gone = {i for i, _, _, kept in plain_components(texts, 80) if not kept}
    texts = [x for x in texts if x[0] not in gone]
    assert gone and texts
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for i, t in texts for x in [[*ids.encode(t, add_special_tokens=False).ids, 0]] for k in range(0, len(x), 2048))

    got = corpus_pipeline.run(spark, out).toPandas()
    assert sorted(zip(*(got[c].tolist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")))) == want
    for _, mine in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert mine["offset"].tolist() == [0, *np.cumsum(mine["length"])[:-1]] and mine["length"].sum() <= 2048
    left = got["length"].sum() / 2048
    assert got["sequence_id"].nunique() <= 1.25 * left + 1


def test_stages_on_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_carry_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS key", "'x' AS judged", "'x' AS scored", "'x' AS doc", "1 AS root", "'x' AS words", "'x' AS own_doc", "'x' AS gone_doc", "'x' AS line_dedup_result")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name
