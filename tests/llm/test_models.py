"""What is learned, on held-out rows, and the edges of the learning operators."""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from cases import SCHEMA, empty, frame, plain_language, plain_toxicity

from folioforge.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    n1 = int(label.sum())
    n0 = len(label) - n1
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def invented(lang, draw, k):
    """Prose of an invented language: words of its own syllables."""
    syllables = {"aa": ["ka", "lo", "mi", "ren", "tus"], "bb": ["schw", "eit", "ung", "ber", "ach"], "cc": ["oi", "eau", "qu", "tion", "é"]}[lang]
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(k))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_held_out(documents):
    got = language_id.identify(documents).toPandas().merge(documents.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda x: zlib.crc32(str(x).encode()) % 3 == 1)).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_predictions_ignore_lang_and_id(spark, documents):
    model = language_id.learn(documents)
    some = documents.limit(50)
    one = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(some, model).collect()}
    other = some.selectExpr("doc_id + 1000000 AS doc_id", "text", "'zz' AS lang")
    assert one == {r["doc_id"] - 1000000: r["lang_pred"] for r in language_id.predict(other, model).collect()}


def test_mixture_proportions(spark):
    draw = random.Random(2)
    rows = [(i, invented(lang, draw, 120), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [(1, invented("aa", draw, 300) + " " + invented("bb", draw, 100)), (2, invented("cc", draw, 200)), (3, "123 !!"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    shares = dict(x.split(":") for x in got[1]["languages"].split(","))
    assert got[1]["lang_pred"] in ("aa", "bb") and set(shares) == {"aa", "bb"}
    bytes_aa, bytes_bb = (len(x.encode()) for x in (invented("aa", random.Random(1), 3000), invented("bb", random.Random(1), 1000)))
    assert abs(float(shares["aa"]) - bytes_aa / (bytes_aa + bytes_bb)) < 0.12
    assert got[2]["languages"].startswith("cc:1") and got[2]["score"] > 0.9
    assert [got[k]["lang_pred"] for k in (3, 4, 5)] == ["und"] * 3 and got[4]["score"] == 0


def test_mixtures_against_plain_loops(spark, documents):
    """Languages, scores and shares of sf0.01's shorter documents, and of mixtures of them, against loops over segments and languages."""
    model = language_id.learn(documents)
    texts = [r["text"] for r in documents.where("length(text) < 2500").orderBy("doc_id").limit(120).collect()]
    texts += [texts[k] + " " + texts[-k - 1] for k in range(30)] + ["", None, "12 34", "x", "\u00e9"]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        lang, score, _ = plain_language(text, *model)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-3, i


def test_too_many_languages(spark, monkeypatch):
    """The most frequent languages are learned, by name where counts tie; a text in another one still gets an answer."""
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [("aaaa bbbb", "x"), ("cccc dddd", "z"), ("eeee ffff", "y"), ("eeee ffff", "y"), ("gggg", None)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model[0] == ["x", "y"]
    got = language_id.predict(spark.createDataFrame([(1, "ffff eeee"), (2, "cccc"), (3, None)], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(got)][::2] == ["y", "und"] and all(r["lang_pred"] in ("x", "y", "und") for r in got)


def test_two_thousand_languages(spark):
    """Values without number in ``lang`` bound neither the answer nor the driver."""
    rows = [(i, f"{'abcdefghij'[i % 10] * 5} {'klmnopqrst'[i // 10 % 10] * 5} {'uvwxyz'[i // 100 % 6] * 4}", f"l{i % 2000:04d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = language_id.learn(df)
    assert len(names) == language_id.MOST_LANGUAGES and table.shape == (language_id.BUCKETS, len(names))
    assert {r["lang_pred"] for r in language_id.predict(df.limit(20), (names, table)).collect()} <= set(names)


def test_documents_of_many_languages(spark):
    """A text of five languages lists them all, and is kept by its largest share even where that language isn't the likeliest of the whole text."""
    draw = random.Random(7)
    letters = {"aa": "bcdf", "bb": "ghjk", "cc": "lmnp", "dd": "qrst", "ee": "vwxz"}
    prose = lambda lang, k: " ".join("".join(draw.choice(letters[lang]) + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(k))
    blend = lambda: " ".join(prose(draw.choice(list(letters)), 1) for _ in range(150))
    rows = [(prose(lang, 150), lang) for lang in letters for _ in range(60)] + [(blend(), "zz") for _ in range(60)]
    train = spark.createDataFrame([(1000 + i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.learn(train)
    mixed = [(i, " ".join(prose(lang, 150 + 60 * (lang == "cc")) for lang in letters)) for i in range(12)]
    got = language_id.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    for r in got:
        shares = {x.split(":")[0]: float(x.split(":")[1]) for x in r["languages"].split(",")}
        assert all(0.1 < shares.get(x, 0) < 0.35 for x in letters), shares
    assert any(r["score"] < 0.2 for r in got)
    both = train.unionAll(spark.createDataFrame([(i, t, None) for i, t in mixed], train.schema))
    kept = {r["doc_id"] for r in language_id.keep_identified(both, 0.2).where("lang IS NULL").collect()}
    assert kept == {i for i, _ in mixed}


def test_language_stage_learns_from_all_rows(spark):
    """The pipeline's stage holds no labelled row out: a language whose rows are in the held-out fold, or have no key, is learned too."""
    seen = []
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1][:120]
    rows = [(k, "zzz qqq xxx jjj " * 5, "zz") for k in held] + [(None, "www kkk vvv ppp " * 5, "ww")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn, language_id.learn = language_id.learn, lambda *a: seen.append(learn(*a)) or seen[-1]
    try:
        kept = language_id.keep_identified(docs, 0.2)
    finally:
        language_id.learn = learn
    assert seen[0][0] == ["ww", "zz"] and kept.count() == len(rows)


def test_language_edges(spark):
    assert language_id.identify(empty(spark)).count() == 0
    unlabelled = frame(spark, [(1, "some text"), (2, None), (None, "x")], lang=None)
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(unlabelled).collect()} == {("und", 0.0)}
    kept = language_id.keep_identified(unlabelled, 0.2)
    assert kept.columns == unlabelled.columns and kept.count() == 2
    clash = spark.createDataFrame([(1, "plain words here", "en", "x")], "doc_id long, text string, lang string, judged string")
    assert language_id.keep_identified(clash, 0.2).columns == clash.columns


def toy(n=300, seed=1):
    draw = random.Random(seed)
    plain = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            words[draw.randrange(len(words))] = draw.choice(["nasty", "awful"])
        rows.append((i, " ".join(words), draw.choice(["en", "fr"])))
        labels.append((i, None, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    """On rows that were not learned from: few mistakes at the fixed threshold."""
    rows, labels = toy(3000, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, known).toPandas()
    got["label"] = got["doc_id"].map({i: y for i, _, y in labels})
    assert (got["held_out"] == got["doc_id"].map(lambda x: zlib.crc32(str(x).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held["label"].to_numpy()) > 0.98
    hit = (held["predicted"] == 1) & (held["label"] == 1)
    assert hit.sum() / max(1, (held["predicted"] == 1).sum()) > 0.9 and hit.sum() / (held["label"] == 1).sum() > 0.9
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all() and got["score"].between(0, 1).all()


def test_toxicity_against_plain_windows(spark, documents):
    """Scores of sf0.01's shorter documents against one window after the other, by one and the same model."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.where("length(text) < 1500").collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents, model).collect()}
    assert len(texts) > 300
    for i, text in texts.items():
        buckets, _ = toxicity.features(pa.array([text]))
        assert abs(got[i] - plain_toxicity(model, buckets.tolist())) < 1e-4, i


def test_toxicity_learns_words(spark):
    rows, labels = toy()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (9999, 0, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, known)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = np.array([y for _, _, y in labels])
    assert auc(np.array([got[i]["score"] for i, *_ in rows]), truth) > 0.95
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and abs(kept.count() - 225) < 25
    again = toxicity.learn(docs.repartition(7), known)
    assert np.allclose(model.embedding, again.embedding) and model.thresholds == again.thresholds


def test_largest_value_windows():
    """Pooled filters against a loop over every window of every row."""
    draw = np.random.default_rng(3)
    first = np.array([0, 0, 1, 4, 4, 11])
    slots = draw.normal(0, 1, (11, len(toxicity._SLOTS), toxicity.FILTERS)).astype(np.float32)
    bias = draw.normal(0, 1, len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32)
    got = toxicity._pooled(slots, first, bias)
    for r in range(5):
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for t in range(first[r], first[r + 1]):
                    v = sum(slots[t + j, toxicity._SLOTS.index((k, j)), f] for j in range(width) if t + j < first[r + 1]) + bias[k * toxicity.FILTERS + f]
                    best = max(best, v)
                assert abs(got[r, k * toxicity.FILTERS + f] - best) < 1e-5


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(empty(spark), labels).count() == 0
    docs = frame(spark, [(1, "a b"), (2, None), (None, "c"), (1, "a b")])
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 4 and {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    one_kind = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, one_kind).collect()} == {0.0}
    assert toxicity.keep_clean(docs, labels).count() == 4
    assert SCHEMA.count("long") == 3
