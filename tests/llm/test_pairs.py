"""Line dedup, near-dedup and components against plain versions."""

import os
import random

import pytest
from cases import corpus, empty, frame, order, plain_components, plain_lines

from folioforge.llm import graph, line_dedup, minhash_dedup
from folioforge.llm.frames import folder


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup(spark, seed):
    texts = corpus(seed=seed)
    got = sorted(((order(r["doc_id"]), r["text"]) for r in line_dedup.dedup(frame(spark, texts)).collect()), key=repr)
    assert got == plain_lines(texts)


def test_line_dedup_second_round(spark, monkeypatch):
    """A line whose most promising earlier line fails on the full sets still finds one that doesn't."""
    monkeypatch.setattr(line_dedup, "FIRST", 1)
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(150):
        base = [word() for _ in range(20)]
        for k in range(4):
            own = list(base)
            for j in draw.sample(range(20), k):
                own[j] = word()
            texts.append((len(texts), " ".join(own)))
    got = sorted(((order(r["doc_id"]), r["text"]) for r in line_dedup.dedup(frame(spark, texts)).collect()), key=repr)
    assert got == plain_lines(texts)


def test_line_dedup_short_lines(spark):
    """Repeated lines of few words go, also paragraphs in scripts without spaces; four words match five that hold them."""
    paragraph = "\u8fd9\u662f\u4e00\u4e2a\u91cd\u590d\u7684\u6bb5\u843d\u3002" * 20
    texts = [(1, f"Read more\n{paragraph}\na b c d\n\n\nother"), (2, f"read  MORE\n{paragraph}\na b c d e\n\n\nb a c"), (3, "more read read\na b c\na b c f\nother two\n \n")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert got == {1: (texts[0][1], 0), 2: ("\n\nb a c", 3), 3: ("a b c f\nother two\n \n", 2)}


def test_line_dedup_short_lines_at_random(spark):
    """Lines of one to six words out of a few, against every pair of lines compared."""
    draw = random.Random(12)
    texts = [(i, "\n".join(" ".join(draw.choice("abcdefghijklmnopq") for _ in range(draw.randint(0, 6))) for _ in range(6))) for i in range(150)]
    got = sorted(((order(r["doc_id"]), r["text"]) for r in line_dedup.dedup(frame(spark, texts)).collect()), key=repr)
    own, seen = [], []
    for i, text in texts:
        kept = []
        for line in text.split("\n"):
            words = frozenset(line.split())
            if not words or not any(5 * len(words & x) >= 4 * len(words | x) for x in seen):
                kept.append(line)
            seen.append(words) if words else None
        own.append(((False, i), "\n".join(kept)))
    assert got == sorted(own, key=repr)


def test_line_dedup_rows_without_an_id(spark):
    """Of equal lines in rows without a doc_id, or in repeated rows of one, the first stays and the others go."""
    line = "these are five plain words"
    for ids in ([None, None, None], [7, 7, 7]):
        same = [r["text"] for r in line_dedup.dedup(frame(spark, [(i, line) for i in ids])).collect()]
        assert sorted(same) == ["", "", line]
        texts = [(i, f"{line}\n{x}") for i, x in zip(ids, ("one", "two", "three"))]
        got = line_dedup.dedup(frame(spark, texts)).collect()
        assert sum(line in r["text"] for r in got) == 1 and sorted(r["text"].split("\n")[-1] for r in got) == ["one", "three", "two"]
        assert sorted(((order(r["doc_id"]), r["text"]) for r in got), key=repr) == plain_lines(texts)


def test_line_dedup_crowds(spark, monkeypatch):
    """Words with many lines: neighbours first, words in parts, and the second round give the same as every pair compared."""
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    monkeypatch.setattr(line_dedup, "BLOCK", 1 << 12)
    monkeypatch.setattr(line_dedup, "HELD", 1 << 12)
    monkeypatch.setattr(line_dedup, "FEW", 0)
    monkeypatch.setattr(line_dedup, "HOT", 16)
    monkeypatch.setattr(line_dedup, "FIRST", 2)
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(12)]
    texts = [(k, " ".join([*common, word(), word()][draw.randint(0, 1) :])) for k in range(120)]
    texts += [(k, " ".join([*draw.sample(common, 9), *[word() for _ in range(draw.randint(1, 4))]])) for k in range(120, 200)]
    texts += [(k, " ".join([*draw.sample(common, 6), *[draw.choice(common) * 2 for _ in range(190)], *[word() for _ in range(draw.choice([2, 170]))]])) for k in range(200, 240)]
    got = sorted(((order(r["doc_id"]), r["text"]) for r in line_dedup.dedup(frame(spark, texts)).collect()), key=repr)
    assert got == plain_lines(texts)


def test_line_dedup_long_lines(spark):
    """Lines long enough for wide bitmaps, at similarities round 0.8."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(12):
        base = [word() for _ in range(draw.randint(170, 700))]
        texts.append((len(texts), " ".join(base)))
        for share in (0.05, 0.1, 0.11, 0.12, 0.2):
            own = list(base)
            for j in draw.sample(range(len(own)), int(share * len(own))):
                own[j] = word()
            texts.append((len(texts), " ".join(own)))
    got = sorted(((order(r["doc_id"]), r["text"]) for r in line_dedup.dedup(frame(spark, texts)).collect()), key=repr)
    assert got == plain_lines(texts)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup(empty(spark)).count() == 0
    assert line_dedup.without_repeated_lines(empty(spark)).count() == 0
    line = "these are five plain words"
    texts = [(None, line), (2, line), (1, f"{line}\nshort one\n{line}"), (3, None), (4, ""), (5, line)]
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup(frame(spark, texts)).collect()}
    assert got == {(1, f"{line}\nshort one"), (2, ""), (None, ""), (3, None), (4, ""), (5, "")}
    kept = line_dedup.without_repeated_lines(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=repr) == sorted([(1, f"{line}\nshort one"), (3, None), (4, "")], key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates(spark, seed):
    texts = corpus(seed=seed)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect()]
    assert sorted(got, key=repr) == plain_components(texts)


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """Groups larger than a tile give the same components."""
    monkeypatch.setattr(minhash_dedup, "TILE", 4)
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(120)]
    texts = []
    for i in range(60):
        own = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4])):
            own[draw.randrange(len(own))] = f"w{draw.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect()]
    assert sorted(got, key=repr) == plain_components(texts)


def test_near_duplicates_large_ids(spark):
    """Any long names a component, the largest and smallest too."""
    for a, b in ((7 * 10**18, 7 * 10**18 + 1), ((1 << 63) - 2, (1 << 63) - 1), (-(1 << 63), -1)):
        texts = [(b, "a b c d e f g"), (a, "a b c d e f g"), (None, "x y z")]
        got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect()}
        assert got == {a: (a, True), b: (a, False), None: (None, True)}
        assert {r["doc_id"] for r in minhash_dedup.keep_one_of_each(frame(spark, texts)).collect()} == {a, None}


def test_tables_left_behind(spark):
    """Of the tables that steps are cut with, those stay that the result reads: the rows and the answer."""
    there = lambda: set(os.listdir(folder(spark).removeprefix("file:")))
    before = there()
    assert minhash_dedup.near_duplicates(frame(spark, corpus())).count() == len(corpus())
    assert len(there() - before) == 2


def test_near_duplicates_edges(spark):
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    assert minhash_dedup.keep_one_of_each(empty(spark)).count() == 0
    texts = [(3, "a b c d e f g"), (1, "A B c d e f g"), (2, None), (4, ""), (5, "x")]
    kept = minhash_dedup.keep_one_of_each(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]


def test_stage_links_from_four_fifths(spark):
    """The pipeline's stage keeps one of two texts at a Jaccard similarity of 0.80 to 0.85, the query both; at under 0.80 both stay."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts, near = [], set()
    for i in range(60):
        base = [word() for _ in range(104)]  # 100 shingles, of which the other text shares all but k
        k = 9 + i % 4  # Jaccard (100 - k) / (100 + k): 0.835, 0.818, 0.802, 0.786
        texts += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-k] + [word() for _ in range(k)]))]
        near |= {2 * i + 1} if k < 12 else set()
    stay = {r["doc_id"] for r in minhash_dedup.keep_one_of_each(frame(spark, texts)).collect()}
    assert {i for i, _ in texts} - stay == near
    assert all(r["kept"] for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect())


def test_chance_of_a_missed_link():
    """Bands and estimate together miss less than one link in a million, by the binomial tail at the least similarity."""
    from math import comb

    for link in (minhash_dedup.QUERY, minhash_dedup.STAGE):
        assert link.rows * link.bands == minhash_dedup.HASHES
        s, n, chance = link.up / link.down, minhash_dedup.HASHES, 1 / 16
        p = s + (1 - s) * chance
        low = sum(comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(n + 1) if (m / n - chance) / (1 - chance) < link.estimate)
        assert (1 - s**link.rows) ** link.bands + low < 1e-6


def test_estimates():
    import numpy as np

    draw = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.85, 1.0):
        found = []
        for _ in range(40):
            both = draw.integers(0, 1 << 63, 600, dtype=np.uint64)
            n = int(600 * share)
            a, b = both, np.concatenate([both[:n], draw.integers(0, 1 << 63, 600 - n, dtype=np.uint64)])
            sig = [minhash_dedup.packed(minhash_dedup.minima(np.unique(x), np.array([0, len(np.unique(x))]))) for x in (a, b)]
            found.append(minhash_dedup.estimates(sig[0], sig[1])[0])
        jaccard = n / (1200 - n)
        assert abs(np.mean(found) - jaccard) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {(r["node"], r["root"]) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
