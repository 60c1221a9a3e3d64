"""The operators that judge or transform one text at a time."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from cases import corpus, empty, frame
from pyspark.sql import functions as F

from folioforge.llm import bpe, edit_fingerprint, license_scan, media_columns, packing, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- media -------------------------------------------------------------------------------------------------------------


def test_media(spark):
    texts = corpus()
    got = media_columns.with_media(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    want = sorted((hashlib.sha256(media_columns.payload_of(t)).hexdigest() for _, t in texts))
    assert sorted(r["payload_sha256"] for r in got) == want
    for r in got:
        rows, channels = media_columns.read_png(bytes(r["media"]))
        payload = rows.tobytes()
        assert channels == 3 and len(payload) % 192 == 0 and r["tail_crc32"] == zlib.crc32(payload[-16:]) and payload.rstrip(b" ") in (payload[: r["n_bytes"]].rstrip(b" "),)
    assert media_columns.with_media(empty(spark)).count() == 0


def plain_png(raw):
    """Samples of a PNG by a reader of its own: chunks by their lengths, pixels one by one."""
    at, data = 8, b""
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        assert int.from_bytes(raw[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 2, 0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    lines, stride = zlib.decompress(data), 3 * width
    before, out, kinds = [0] * stride, [], set()
    for y in range(height):
        kind, *line = lines[y * (stride + 1) : (y + 1) * (stride + 1)]
        kinds.add(kind)
        for x in range(stride):
            a, c = (line[x - 3], before[x - 3]) if x >= 3 else (0, 0)
            b = before[x]
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[x] = (line[x] + [0, a, b, (a + b) // 2, near][kind]) % 256
        out += line
        before = line
    return bytes(out), kinds


def plain_hash(samples):
    """Signs of the lowest frequencies of brightness on a grid, term by term."""
    rows = [[sum(samples[y * 192 + 3 * x : y * 192 + 3 * x + 3]) for x in range(64)] for y in range(len(samples) // 192)]
    rows = [r for r in rows for _ in range(-(-32 // len(rows)) if len(rows) < 32 else 1)]
    mean = lambda x: sum(x) / len(x)
    cut = [k * len(rows) // 32 for k in range(33)]
    grid = [[mean([rows[y][x] for y in range(cut[i], cut[i + 1]) for x in (2 * j, 2 * j + 1)]) for j in range(32)] for i in range(32)]
    low = [sum(grid[y][x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    return low


def test_media_against_a_plain_reader(spark):
    """Every row of sf0.001, and odd texts: what an independent reader finds in the stored form, with all kinds of filters; and the transform term by term."""
    import pyarrow.parquet as pq

    texts = [(i, t) for i, t in enumerate(pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()) if len(t or "") < 20_000]
    texts += [(10_000, None), (10_001, ""), (10_002, "\u00e9" * 500), (10_003, "".join(chr(33 + k * k % 90) for k in range(5000)))]
    kinds = set()
    for r in media_columns.with_media(frame(spark, texts)).collect():
        raw = (dict(texts)[r["doc_id"]] or "").encode()
        payload, found = plain_png(bytes(r["media"]))
        kinds |= found
        assert payload == raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        if r["doc_id"] % 20 == 0:
            low = plain_hash(payload)
            bits = bin(int(r["feature"], 16))[2:].zfill(64)
            edge = np.median(low)
            assert all((b == "1") == (x > edge) for b, x in zip(bits, low) if abs(x - edge) > 1e-6)
    assert kinds == {0, 1, 2, 3, 4}


def filtered(kind, rows, step):
    """Rows under one of the five filters, by the book."""
    out = np.zeros_like(rows)
    for y in range(len(rows)):
        for x in range(rows.shape[1]):
            a = int(rows[y, x - step]) if x >= step else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, x] = (int(rows[y, x]) - [0, a, b, (a + b) // 2, near][kind]) & 255
    return out


@pytest.mark.parametrize("step", [1, 3, 4])
def test_unfilter(step):
    rows = np.random.default_rng(1).integers(0, 256, (7, 6 * step), dtype=np.uint8)
    for kind in range(5):
        assert (media_columns.unfilter(np.full(7, kind, np.uint8), filtered(kind, rows, step), step) == rows).all()
    mixed = np.array([4, 0, 1, 2, 3, 4, 1], np.uint8)
    lines = np.stack([filtered(k, rows, step)[y] for y, k in enumerate(mixed)])
    assert (media_columns.unfilter(mixed, lines, step) == rows).all()


def test_damaged_png():
    png = media_columns.write_png(media_columns.payload_of("text"))
    for bad in (png[:-5], b"x" + png[1:], png[:40] + bytes([png[40] ^ 1]) + png[41:], png[:33]):
        with pytest.raises(ValueError):
            media_columns.read_png(bad)


def test_cosine_hash_is_stable_under_small_changes():
    draw = np.random.default_rng(4)
    rows = np.cumsum(np.cumsum(draw.normal(0, 1, (64, 192)), axis=0), axis=1)
    rows = ((rows - rows.min()) / np.ptp(rows) * 255).astype(np.uint8)
    noisy = np.clip(rows.astype(int) + draw.integers(-2, 3, rows.shape), 0, 255).astype(np.uint8)
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert apart(media_columns.cosine_hash(rows, 3), media_columns.cosine_hash(noisy, 3)) <= 4
    assert apart(media_columns.cosine_hash(rows, 3), media_columns.cosine_hash(rows[::-1], 3)) > 8


# --- byte-level BPE ------------------------------------------------------------------------------------------------------


def awkward():
    return [t for _, t in corpus() if t] + ["a" * 3000, "don't 'll  we've\n\n\n x" * 40, " " * 700 + "x", "1234567890" * 60, "日本語テキスト" * 90, "\t \n" * 300, "!?!" * 500 + "'s" * 200, "x 　　y" * 90, "\x1c\x1d a\x1e b" * 60, "<|endoftext|> é́́ " * 30]


@pytest.mark.parametrize("leaf,window", [(8, 16), (64, 40), (1 << 14, 1 << 13)])
def test_tree_encoding(leaf, window):
    tree = bpe.TreeBPE(RANKS, public_tokenizers.PATTERN, leaf, window)
    for text in awkward():
        ids = tree.encode(text)
        assert ids == tree.encoding.encode_ordinary(text), text[:40]
        assert tree.decode(ids) == text.encode()


def test_bpe_rows(spark):
    texts = corpus()
    got = bpe.with_tokens(frame(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN).encoding
    assert isinstance(own, tiktoken.Encoding)
    want = sorted((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in texts for ids in [own.encode_ordinary(t or "")])
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.with_tokens(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_every_text_takes_the_tree(monkeypatch):
    """All documents of two characters or more are joined from halves, and none is encoded whole."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    tree = bpe.TreeBPE(RANKS, public_tokenizers.PATTERN)
    joins, longest = [0], [0]
    whole, join = tree.encoding.encode_ordinary, tree.join
    monkeypatch.setattr(tree, "join", lambda *x: joins.__setitem__(0, joins[0] + 1) or join(*x))

    class Leaves:
        def encode_ordinary(self, text):
            longest[0] = max(longest[0], len(text))
            return whole(text)

        def _encode_single_piece(self, raw):
            return own._encode_single_piece(raw)

    own = tree.encoding
    monkeypatch.setattr(tree, "encoding", Leaves())
    for text in texts:
        before = joins[0]
        assert tree.encode(text or "") == whole(text or "")
        assert joins[0] - before >= (len(text or "") > 1) + (len(text or "") > 2 * tree.leaf) * len(text or "") // (4 * tree.leaf)
    assert longest[0] <= max(tree.leaf, tree.window)


# --- packing -------------------------------------------------------------------------------------------------------------


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    own, theirs = packing.WordIds(WORDS), Tokenizer.from_file(WORDS)
    import pyarrow as pa

    from folioforge.llm.frames import flat

    texts = awkward() + ["", "It's we'll DON'T", "a.b,c;d 12.5 x2y", "É. «é» .é ñ!ñ", "<|endoftext|>", "<|STARTOFTEXT|>x", "ß İ Σ ς ﬁ", "e\u0301. \u0301e", "naïve—test…", "a\u00a0b \u2028c", "\u00d7\u00f7.\u00d7"]
    ids, bounds = own.ids(*flat(pa.array(texts)))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*theirs.encode(text, add_special_tokens=False).ids, 0], text[:50]


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_each_place_once(seed):
    draw = np.random.default_rng(seed)
    counts = {int(x): int(n) for x, n in zip(draw.integers(1, 101, 40), draw.integers(1, 5000, 40))}
    runs = packing.plan(counts, 100)
    taken, held = {}, {}
    for length, first, n, sequence, each, offset in runs:
        assert taken.get(length, 0) == first
        taken[length] = first + n
        for i in range(n):
            held.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
    assert taken == counts
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(x * n for x, n in counts.items())
    assert max(held) + 1 == len(held) and len(held) <= 1.25 * total / 100 + 50


def test_plan_is_best_fit_decreasing():
    """As many sequences as best fit over single pieces takes."""
    draw = np.random.default_rng(9)
    counts = {int(x): int(n) for x, n in zip(draw.integers(1, 51, 20), draw.integers(1, 30, 20))}
    rooms = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(50 - length)
    assert max(s + -(-n // e) for _, _, n, s, e, _ in packing.plan(counts, 50)) == len(rooms)


def test_pack(spark):
    texts = corpus()
    got = packing.pack(frame(spark, texts), WORDS).toPandas()
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048
    ids = packing.WordIds(WORDS).tokenizer
    want = sorted((i if i is not None else -1, k // 2048, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for i, t in texts for x in [[*ids.encode(t or "", add_special_tokens=False).ids, 0]] for k in range(0, len(x), 2048))
    assert sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.piece, r.length, r.ids_crc32) for r in got.itertuples()) == want
    assert packing.pack(empty(spark), WORDS).count() == 0


# --- license scan --------------------------------------------------------------------------------------------------------

LICENSED = [
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "MIT License", "cc-by", "Apache License, Version 2.0\nmit license; MIT  LICENSE", "gnu general public licenses", "xmit license",
    "Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: MIT", "All rights\nreserved. Copyright 2020", "émit license", "a cc by b cc by", "GNU\x01General\x02Public License", "no terms here", "3-clause BSD license", "the unlicense",
]


def plain_scan(text):
    """Spans by scanning each rule's matches with no gate, and each pair of spans for suppression."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "").replace("\x01", " ").replace("\x02", " "))
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    base = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if [w for _, w in words[k : k + len(phrase.split())]] == phrase.split()]
    spans = [(r.label, r.priority, m.start(), m.end()) for r in license_scan.SIGNATURES for m in re.finditer(r.regex, low)]
    around = lambda o, s: o[0] != s[0] and o[2] <= s[2] and o[3] >= s[3] and (o[1] > s[1] or (o[1] == s[1] and o[3] - o[2] > s[3] - s[2]))
    left = [s for s in spans if not any(around(o, s) for o in spans)]
    own = {label for _, label in base}
    score = max([s[1] for s in left] + [60] * bool(base), default=0) / 100
    at = [k for k, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in left})), score)


def test_license_scan(spark):
    texts = [*corpus(), *enumerate(LICENSED, 2000), (3000, "filler words " * 3000 + "mit license " * 40 + "filler " * 100)]
    got = license_scan.scan(frame(spark, texts)).collect()
    found = sorted((r["doc_id"] or -1, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in got if r["doc_id"] != 1006)
    assert found == sorted((i or -1, *plain_scan(t)) for i, t in texts if i != 1006)
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_scan_of_many_matches(spark):
    """Hundreds of matches that overlap, over many blocks of spans, against every pair of spans compared; twenty thousand of them in seconds."""
    import random
    import time

    draw = random.Random(3)
    parts = ["mit license", "apache license", "gnu general public license version 2 or any later version", "cc by-nc 4.0", "gnu general public license", "apache license version 2.0", "x", "all rights reserved", "creative commons attribution sharealike 4.0 international license"]
    texts = [(k, " ".join(draw.choice(parts) for _ in range(400))) for k in range(4)]
    got = license_scan.scan(frame(spark, texts)).collect()
    found = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in got)
    assert found == sorted((i, *plain_scan(t)) for i, t in texts)
    began = time.monotonic()
    long = license_scan.scan(frame(spark, [(1, "mit license apache license " * 10_000)])).first()
    assert long["n_base"] == 20_000 and time.monotonic() - began < 60


def test_license_scan_deals_rows_and_names_what_words_have(spark, tmp_path):
    """A table in one row group is no single task, whatever its keys; patterns have no negated classes of ranges, which are slow, and words are the same."""
    texts = [(None if i % 3 else 7, x) for i, x in enumerate(["a-b Mit\u00e9 LICENSE_x", "\x7f\x80 a\U0010ffffb {0}", "", " - ", "MIT License"] * 200)]
    frame(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = license_scan.scan(spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1))
    assert rows.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism
    plain = [len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)) for _, t in texts]
    assert sorted(r["n_words"] for r in rows.collect()) == sorted(plain) and max(plain) == 5
    assert not any("[^\\x" in r.regex for r in [*license_scan.SIGNATURES, *license_scan._BASE_RULES])


def test_license_stems_cover_the_rules():
    """Whatever a rule matches at the least holds its keyword and a stem."""
    for text in LICENSED:
        low = text.lower()
        for r in license_scan.SIGNATURES:
            if re.search(r.regex, low):
                assert r.keyword in low and any(s in low for s in license_scan.STEMS), (text, r.label)


def matches_of(pattern, limit=400):
    """Texts that a pattern of this package matches: every alternative, repetitions at their least and (up to one more) their most, a class's first characters."""
    from itertools import islice, product
    from re import _parser

    def texts(tokens):
        return ["".join(x) for x in islice(product(*[choices(op, arg) for op, arg in tokens]), limit)]

    def choices(op, arg):
        kind = str(op)
        if kind == "LITERAL":
            return [chr(arg)]
        if kind in ("ANY", "NOT_LITERAL"):
            return ["x"]
        if kind == "AT":
            return [""]
        if kind == "IN":
            if str(arg[0][0]) == "NEGATE":
                return ["."]
            return [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg][:2]
        if kind == "BRANCH":
            return [x for branch in arg[1] for x in texts(branch)]
        if kind == "SUBPATTERN":
            return texts(arg[3])
        assert kind in ("MAX_REPEAT", "MIN_REPEAT"), kind
        least, most, inner = arg
        own = texts(inner)
        return [x * least for x in own[: len(own) if least else 1]] + [x * (least + 1) for x in own if most > least]

    return texts(_parser.parse(pattern))


def test_each_signature_matches_its_texts(spark):
    """Every alternative spelling of every signature fires it: optional parts and optional spaces there or not; the scan agrees."""
    lines = license_scan._TEXT.strip().splitlines()
    assert len(lines) == len(license_scan.SIGNATURES)
    positive = []
    for line, rule in zip(lines, license_scan.SIGNATURES):
        texts = matches_of(line.split(" | ", 1)[1])
        assert texts
        for text in texts:
            assert (m := re.search(rule.regex, text)) and m.start() == 0, (rule.label, text)
            assert rule.keyword in text and any(s in text for s in license_scan.STEMS), (rule.label, text)
        positive += [*texts[:3], *texts[-3:]]
    ordinary = {
        "Creative Commons Attribution NonCommercial": "cc-by-nc", "Creative Commons Attribution-ShareAlike": "cc-by-sa", "Creative Commons Attribution NoDerivs": "cc-by-nd", "beerware license": "beerware", "multilicensed": "multi-license",
        "openrail license": "rail-m", "CreativeML OpenRAIL-M License": "rail-m", "Copyright 2020": "copyright-notice", "copyright (c) 2020": "copyright-notice", "x:  open rail license": "rail-m",
    }
    texts = list(enumerate([*ordinary, *sorted(set(positive))]))
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, texts)).collect()}
    for i, (text, label) in enumerate(ordinary.items()):
        assert got[i]["labels"].split(",").count(label) == 1 and "cc-by" not in got[i]["labels"].split(","), text
    for i, text in texts:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(text), text


# --- URL filter ----------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://x.org", "HTTP://Www.EXAMPLE.org/en/12?x#y", "https://example.org/es/", "https://sub.example.org/de/", "ftp://a.com/fr/x", "http://b.com/de/1", "http://notexample.com?/fr/", "http://spam-farm.example.net/en/1",
    "http://a.net/cheap-pills", "http://a.net/research/spam-farm", "http://a.net/gambling-addiction-help/casino-win", "x://y.com:80/fr/", "http://casino.example.net/win", "http://org/", "http://a.net/CASINO-WIN", "://", "a://b://c/d", "http://caf\u00e9.com/fr/\n",
]


def test_url_filter(spark):
    rows = [(i, u, "<html>") for i, u in enumerate(URLS)] + [(None, URLS[4], None), (3, URLS[3], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    pages = duckdb.connect()
    pages.register("pages", df.toPandas())
    want = sorted(map(repr, pages.sql(url_filter.judge_sql()).df().astype(object).where(lambda x: x.notna(), None).values.tolist()))
    got = url_filter.judge(df).toPandas().astype(object).where(lambda x: x.notna(), None)
    fix = lambda x: repr([None if v is None else int(v) if isinstance(v, float) else v for v in eval(x, {"nan": None})])
    assert sorted(fix(repr(r)) for r in got.values.tolist()) == sorted(map(fix, want))
    assert url_filter.judge(df.where("false")).count() == 0


def test_url_rules_name_what_they_need():
    """Each rule's literals are whole tokens of what it matches, and it is filed under the rarest."""
    index = url_filter.rule_index(url_filter.PATTERN_RULES, {"casino": 100, "win": 5, "spam": 2, "farm": 50})
    assert any(r.label == "casino-win" for r in index["win"]) and any(r.label == "spam-farm" for r in index["spam"])
    for r in url_filter.PATTERN_RULES:
        for url in URLS:
            if url and re.search(r.regex, url.lower()):
                assert set(r.literals) <= set(re.split("[^a-z0-9]+", url.lower())), (r.label, url)


def test_url_rules_under_every_filing(spark):
    """Each rule is fetched for all its alternatives, whichever of its literals is the rarest; a verdict doesn't hang on the rest of the table."""
    rules = url_filter.PATTERN_RULES
    urls = {r.label: matches_of(r.regex) for r in rules}
    for r in rules:
        for url in urls[r.label]:
            assert re.search(r.regex, url), (r.label, url)
            tokens = set(re.split("[^a-z0-9]+", url))
            for rarest in r.literals:
                index = url_filter.rule_index(rules, {x: int(x != rarest) for s in rules for x in s.literals})
                assert any(r in index.get(t, []) for t in tokens), (r.label, url, rarest)
    for extra in ([], ["http://a.net/farm"] * 5, ["http://a.net/link"] * 5, ["http://a.net/sports", "http://a.net/betting/betting"]):
        texts = ["http://a.net/links-farm", "http://a.net/link_farm", "http://a.net/sport-betting", "http://a.net/sports.betting", *extra]
        got = {r["page_id"]: (r["labels"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")).collect()}
        assert [got[i] for i in range(4)] == [("link-farm", "block")] * 2 + [("sports-betting", "block")] * 2
    texts = sorted({u for found in urls.values() for u in found})
    got = {texts[r["page_id"]]: set(r["labels"].split(",")) for r in url_filter.judge(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")).collect()}
    assert all(got[u] == {r.label for r in rules if re.search(r.regex, u)} for u in texts)


# --- edit fingerprints -----------------------------------------------------------------------------------------------------


def plain_walk(text):
    """One symbol a step, from the character a walk stands on, by the tables' definition; and the samples of the steps."""
    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * by % (1 << 64)
        return x ^ (x >> 31)

    out, at, step = [], 0, 0
    while at < len(text):
        cell = step % edit_fingerprint.PERIOD * edit_fingerprint.CLASSES + (ord(text[at]) * 2654435761 % (1 << 32) >> 24)
        out.append("0123456789abcdef"[mixed(cell + (1 << 40)) >> 60])
        at += mixed(cell) >> 63
        step += 1
    def steps():
        yield 0
        for octave in range(40):
            width = (1 << octave) // edit_fingerprint.SAMPLES
            for k in range(1 << octave if octave < edit_fingerprint.FIRST else edit_fingerprint.SAMPLES):
                yield (1 << octave) + (k if octave < edit_fingerprint.FIRST else k * width + mixed(k + (octave << 20)) % width)

    chosen = []
    for s in steps():
        if s >= len(out):
            break
        chosen.append(out[s])
    return "".join(chosen)


@pytest.mark.parametrize("runs", [1, 5, 40])
def test_fingerprints(spark, runs):
    """Against one walk after the other in plain Python, with null and repeated ids."""
    texts = [*corpus(), *[(None, f"without an id {k}") for k in range(30)], *[(1002, f"one id {k}") for k in range(30)]]
    got = edit_fingerprint.with_fingerprints(frame(spark, texts), runs=runs).collect()
    tie = lambda t: (n := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (n >> 63 << 64)
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1])))
    want = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 4
        other = text[: len(text) - n] + after[:n]
        want.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), plain_walk(text), plain_walk(other)))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert edit_fingerprint.with_fingerprints(empty(spark)).count() == 0


def test_runs_keep_the_order():
    """Runs follow (doc_id, hash), and a doc_id with a third of the rows, or rows without one, fall into several."""
    draw = np.random.default_rng(5)
    docs = np.concatenate([draw.integers(-50, 50, 300), np.full(300, 7), np.zeros(300, np.int64)])
    null = np.arange(900) >= 600
    hashes = draw.integers(-(1 << 63), (1 << 63) - 1, 900)
    runs = edit_fingerprint.Runs([int(x) for x in np.quantile(docs[:600], np.arange(1, 12) / 12, method="lower")], 4)
    found = runs.of(docs, null, hashes)
    order = np.lexsort((hashes, docs, ~null))
    assert (np.diff(found[order]) >= 0).all()
    assert len(set(found[null])) == 4 and len(set(found[300:600])) > 3 and found.max() < 30


def test_recall_of_near_pairs(spark, monkeypatch):
    """At least nine of ten pairs whose likeness is NEAR or more are found, of all pairs compared."""
    draw = np.random.default_rng(11)
    prose = lambda k: "".join(map(chr, draw.integers(97, 123, k)))
    texts = []
    for _ in range(40):
        base = prose(int(draw.integers(200, 3000)))
        for edits in (0, 1, 3, 6, 12):
            own = list(base)
            for k in draw.integers(0, len(own), edits).tolist():
                own[k] = prose(int(draw.integers(0, 3)))
            texts.append("".join(own))
    prints = edit_fingerprint.fingerprints([edit_fingerprint.code_points(t) for t in texts])
    got = {(r["a"], r["b"]) for r in edit_fingerprint.near_pairs(spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if edit_fingerprint.likeness(prints[i], prints[j]) >= edit_fingerprint.NEAR}
    assert len(want) > 100 and got <= want and len(got) >= 0.9 * len(want)


def test_fingerprint_edges(spark):
    texts = [(1, "same text here"), (1, "same text here"), (None, "none"), (2, None)]
    got = edit_fingerprint.with_fingerprints(frame(spark, texts)).collect()
    assert len(got) == 4 and {r["fingerprint"] for r in got if r["doc_id"] == 2} == {""}
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    one = edit_fingerprint.with_fingerprints(frame(spark, [(7, "only")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(7, 1.0)]


def test_likeness_falls_with_edits():
    draw = np.random.default_rng(6)
    text = draw.integers(97, 123, 4000).astype(np.uint32)
    before = 1.0
    for edits in (0, 3, 30, 300, 3000):
        other = np.delete(text, draw.choice(len(text), edits, replace=False)) if edits else text
        a, b = edit_fingerprint.fingerprints([text, other])
        like = edit_fingerprint.likeness(a, b)
        assert like <= before + 0.05
        before = like
    assert before < 0.3


def test_near_pairs(spark):
    texts = [x for x in corpus() if x[0] is not None and x[0] != 1006 and len(x[1] or "") > 200]
    prints = edit_fingerprint.with_fingerprints(frame(spark, texts)).select("doc_id", "fingerprint")
    found = {(r["a"], r["b"]) for r in edit_fingerprint.near_pairs(prints).collect()}
    own = dict(texts)
    copies = [(a, b) for a in own for b in own if a < b and own[a] == own[b]]
    linked = {x for p in found for x in p}
    assert copies and all(a in linked and b in linked for a, b in copies)
    prints = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert all(edit_fingerprint.likeness(prints[a], prints[b]) >= edit_fingerprint.NEAR for a, b in found)


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_pairs_are_all_pairs(spark, monkeypatch, tile):
    """Every two rows that share a band and are alike, also where the bucket's first row is unlike both, and equal short texts."""
    monkeypatch.setattr(edit_fingerprint, "TILE", tile)
    draw = np.random.default_rng(3)
    prose = lambda k: "".join(map(chr, draw.integers(97, 123, k)))
    opening, body = prose(300), prose(3000)
    texts = [(0, opening + prose(3000)), (1, opening + body), (2, opening + body[:2900] + prose(100)), (3, opening + prose(3000)), (4, "ab"), (5, "ab"), (6, "x"), (7, None), (None, opening + body)]
    texts += [(10 + k, opening + body[: 1000 + 100 * k]) for k in range(20)]
    prints = [(i, edit_fingerprint.fingerprints([edit_fingerprint.code_points(t or "")])[0]) for i, t in texts]
    got = [(r["a"], r["b"], round(r["likeness"], 9)) for r in edit_fingerprint.near_pairs(spark.createDataFrame(prints, "doc_id long, fingerprint string")).collect()]
    known = [(i, x) for i, x in prints if i is not None]
    want = [(i, j, round(edit_fingerprint.likeness(x, y), 9)) for i, x in known for j, y in known if i < j and set(edit_fingerprint.bands(x)) & set(edit_fingerprint.bands(y)) and edit_fingerprint.likeness(x, y) >= edit_fingerprint.NEAR]
    assert sorted(got) == sorted(want)
    assert {(1, 2), (4, 5)} <= {x[:2] for x in got} and not any(x[0] == 0 for x in got)


def test_text_columns_may_have_other_names(spark):
    df = frame(spark, [(1, "mit license")]).select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    assert license_scan.scan(df, text="body", key="id").first()["n_base"] == 1
    assert media_columns.with_media(df, "body", "id").first()["n_bytes"] == 11
    assert bpe.with_tokens(df, RANKS, public_tokenizers.PATTERN, "body", "id").first()["n_tokens"] == 2
