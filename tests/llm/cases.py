"""Small corpora for the operators' tests, and plain versions of what they compute."""

import math
import random
import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, bucket string, hash int, words string, part int"
SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in SPACE.split(lower(text or "")) if w]


def rows(texts, lang="en"):
    """Rows of documents with extra columns whose names the operators use inside."""
    return [(i, t, lang, f"src{(i or 0) % 3}", None, 1, "b", 2, "w", 3) for i, t in texts]


def corpus(n=60, seed=3):
    """Random prose with copies, near copies of several degrees, repeated lines, and the edge cases."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    line = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    texts, common = [], line(12)
    for i in range(n):
        lines = [line(draw.randint(3, 25)) for _ in range(draw.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(draw.randrange(len(lines) + 1), common)
        texts.append("\n".join(lines))
    for i in range(n // 2):
        base = texts[draw.randrange(n)].split(" ")
        for _ in range(draw.choice([0, 1, 1, 2, 4])):
            base[draw.randrange(len(base))] = draw.choice(vocabulary)
        texts.append(" ".join(base))
    out = list(enumerate(texts, 10))
    out += [(1000, None), (1001, ""), (1002, "  \n\n "), (1003, "one"), (1004, "One two"), (1005, "one two\n"), (None, texts[0]), (None, None), (1006, texts[1]), (1006, texts[1])]
    out.append((1007, " ".join(draw.choice(vocabulary) for _ in range(30_000))))
    out.append((1008, "é ñ 日本語 😀 " * 50))
    draw.shuffle(out)
    return out


def frame(spark, texts, lang="en"):
    return spark.createDataFrame(rows(texts, lang), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def plain_lines(texts):
    """The texts without later matches, every line compared with every earlier one. Rows without an id, and those of one id, go by their texts' hashes."""
    tie = lambda t: (n := xxhash.xxh64((t or "").encode(), seed=42).intdigest()) - (n >> 63 << 64)
    out, seen = [], []
    for i, t in sorted(texts, key=lambda x: (order(x[0]), tie(x[1]))):
        kept = []
        for line in (t or "").split("\n"):
            own = frozenset(w for w in SPACE.split(lower(line)) if w)
            if not own or not any(5 * len(own & x) >= 4 * len(own | x) for x in seen):
                kept.append(line)
            if own:
                seen.append(own)
        out.append((order(i), "\n".join(kept) if t is not None else None))
    return sorted(out, key=repr)


def plain_components(texts, least=85):
    """(doc_id, set size, smallest id of the component, kept), every pair of sets compared."""
    sets = []
    for i, t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(find(k), []).append(texts[k][0])
    out = []
    for k, (i, _) in enumerate(texts):
        ids = [x for x in groups[find(k)] if x is not None] if sets[k] else [i] * (i is not None)
        root = min(ids, default=None)
        out.append((i, len(sets[k]), root, root is None or i == root))
    return sorted(out, key=repr)


def plain_language(text, names, table, segment=64, steps=12, share=0.25, penalty=4.0):
    """(language, score, its share) by expectation-maximisation in plain loops over segments and languages."""
    if not names or not any(map(str.isalpha, text or "")):
        return "und", 0.0, 0.0
    raw = b" " + bytes(c + 32 if 65 <= c < 91 else c if c > 127 or 97 <= c < 123 else 32 for c in text.encode()) + b"   "
    codes = [int.from_bytes(raw[k : k + 4], "little") * 2654435761 % (1 << 32) >> 16 for k in range(len(raw) - 3)]
    logs = [[share * math.fsum(float(table[c][n]) for c in codes[k : k + segment]) for n in range(len(names))] for k in range(0, len(codes), segment)]
    like = [[math.exp(x - max(row)) for x in row] for row in logs]

    def fitted(allowed):
        w = [1 / len(allowed) if n in allowed else 0.0 for n in range(len(names))]
        for _ in range(steps):
            parts = [[x * y for x, y in zip(row, w)] for row in like]
            w = [sum(p[n] / max(sum(p), 1e-300) for p in parts) / len(like) for n in range(len(names))]
        return w, sum(math.log(max(sum(x * y for x, y in zip(row, w)), 1e-300)) for row in like)

    first = fitted(range(len(names)))[0]
    ranked = sorted(range(len(names)), key=lambda n: -first[n])
    best, chosen = -math.inf, first
    for k in range(1, len(names) + 1):
        w, fit = fitted(ranked[:k])
        fit -= penalty * k + 0.5 * k * math.log(len(like))
        if fit > best:
            best, chosen = fit, w
    whole = [sum(row[n] for row in logs) for n in range(len(names))]
    odds = [math.exp(x - max(whole)) for x in whole]
    n = max(range(len(names)), key=lambda k: chosen[k])
    return names[n], min(1.0, chosen[n] * max(odds[n] / sum(odds), chosen[n])), chosen[n]


def plain_toxicity(model, buckets):
    """A score from the buckets of a text's words, window by window."""
    pooled = []
    vectors = [sum(model.embedding[b].astype(np.float64) for b in own) for own in buckets]
    for k, width in enumerate((1, 2, 3)):
        first = sum((1, 2, 3)[:k])
        values = [sum((vectors[t + j] @ model.filters[first + j] for j in range(width) if t + j < len(vectors)), start=np.zeros(8)) + model.bias[8 * k : 8 * k + 8] for t in range(len(vectors))]
        pooled += list(np.maximum(np.max(values, axis=0), 0)) if values else [0.0] * 8
    logit = float(np.dot(pooled, model.weights) + model.offset)
    return 1 / (1 + math.exp(-max(-30, min(30, model.scale * logit + model.shift))))
