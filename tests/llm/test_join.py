"""The n-gram join against all pairs of sets compared."""

import random

import numpy as np
import pytest
from cases import corpus, empty, frame, plain_components

from folioforge.llm import minhash_dedup, ngram_join


def check(spark, texts):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(frame(spark, texts)).collect()]
    assert sorted(got, key=repr) == sorted((x[:3] for x in plain_components(texts, 80)), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_join(spark, seed):
    check(spark, corpus(seed=seed))


def test_short_texts(spark):
    """Sets of one to twelve shingles, where one shingle more or less decides."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(40):
        base = [draw.choice(words) for _ in range(draw.randint(0, 16))]
        texts.append((len(texts), " ".join(base)))
        for _ in range(3):
            texts.append((len(texts), " ".join([*base, *(draw.choice(words) for _ in range(draw.randint(0, 3)))][draw.randint(0, 1) :])))
    check(spark, texts)


@pytest.mark.parametrize("limits", [(1024, 1 << 16, 256), (4, 3, 2)])
def test_families(spark, monkeypatch, limits):
    """Families of texts of all degrees of likeness; with small limits buckets are handed on as they come and compared in tiles."""
    monkeypatch.setattr(minhash_dedup, "TILE", limits[0])
    monkeypatch.setattr(ngram_join, "TILE", limits[0])
    monkeypatch.setattr(ngram_join, "LIST", limits[1])
    monkeypatch.setattr(ngram_join, "PART", limits[2])
    draw = random.Random(5)
    texts = []
    for size in (30, 120, 400):
        base = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(size)]
        for _ in range(35):
            own = list(base)
            for _ in range(draw.randrange(1 + size // 20)):
                own[draw.randrange(len(own))] = f"w{draw.randrange(10**6)}"
            texts.append((len(texts), " ".join(own)))
    draw.shuffle(texts)
    check(spark, texts)


def test_similar_sets_share_a_signature():
    """Pairs of sets at the least similarity, of all sizes, share a signature that some feature stands behind."""
    draw = np.random.default_rng(1)
    for _ in range(1500):
        size = int(draw.choice([5, 6, 7, 8, 9, 10, 11, 13, 17, 21, 26, 33, 40, 60, 100, 200, 700]))
        common = size - int(draw.integers(0, size // 5 + 1))
        more = int(common / 0.8) - size
        if more < 0 or (more == 0 and common == size):
            continue
        a = draw.integers(0, 2**63, size, dtype=np.uint64)
        b = np.concatenate([a[:common], draw.integers(0, 2**63, more, dtype=np.uint64)])
        found, row = ngram_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), ngram_join.QUERY)
        assert np.intersect1d(found[row == 0], found[row == 1]).size


def test_signatures_where_no_parting_does(monkeypatch):
    """Sets for which the one parting that is allowed doesn't hold count signatures without features too."""
    monkeypatch.setattr(ngram_join, "PARTINGS", 1)
    test_similar_sets_share_a_signature()


def test_unrelated_sets_share_none():
    draw = np.random.default_rng(2)
    for size in (5, 9, 30, 300):
        found, row = ngram_join.signatures(np.concatenate([np.sort(draw.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(200)]), np.arange(201) * size, ngram_join.QUERY)
        assert len(np.unique(found)) == len(found) and len(found) < 1.5 * len(row) and set(row.tolist()) == set(range(200))


def test_sketches_lose_no_link():
    """Sets at the least similarity pass, whatever their sizes; sets far apart don't."""
    draw = np.random.default_rng(3)
    view = lambda x: np.frombuffer(ngram_join.sketch(x), np.uint64)
    for size in (5, 9, 40, 127, 128, 129, 300, 1000, 4000):
        for _ in range(20):
            common = size - int(draw.integers(0, size // 5 + 1))
            a = draw.integers(0, 2**63, size, dtype=np.uint64)
            b = np.concatenate([a[:common], draw.integers(0, 2**63, int(common / 0.8) - size, dtype=np.uint64)])
            assert minhash_dedup.similar(a, b, ngram_join.QUERY) and ngram_join.may_link(view(a), view(b), ngram_join.QUERY) and ngram_join.may_link(view(b), view(a), ngram_join.QUERY)
        far = np.concatenate([a[: size // 2], draw.integers(0, 2**63, size // 2, dtype=np.uint64)])
        assert not ngram_join.may_link(view(a), view(far), ngram_join.QUERY)


def test_edges(spark):
    assert ngram_join.joined(empty(spark)).count() == 0
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, None), (None, "a b"), (None, None)])
    check(spark, [(7, "A b c d e f g"), (7, "a B c d e f g"), (None, "a b c d e f g"), ((1 << 63) - 1, "a b c d e f g"), (9, "x"), (8, "X")])
