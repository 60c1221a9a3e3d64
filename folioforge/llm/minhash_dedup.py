"""Near-duplicate documents by b-bit MinHash, confirmed on full sets of word shingles.

A document is the set of its runs of five words (A-Z lower-cased, parted by ASCII white space); one with fewer words is
its whole sequence. Documents of equal sets are one class. A class has 120 minima of independent hash functions; the
low 4 bits of each make its packed signature, and hashes of a few minima each make bands. Two classes that agree in a
band are candidates. Within a band's bucket, similarity is estimated from the count of equal 4-bit cells, corrected for
chance agreement; pairs estimated high enough are tied together.

Ties are confirmed on full sets in two steps. First each class is compared with the first one that it is tied to; most
groups are whole after that. Parts that ties still join are then compared exactly, all members of different parts. The confirmed links make the components.

A ``Link`` says from which similarity documents are linked, and how such pairs are searched. A pair right at it meets in
no band, or is estimated too low, with a chance of 8.5e-7 for QUERY (0.85) and 1.9e-7 for STAGE (0.8); a pair above it
with less.

Buckets and groups are dealt in tiles of bounded size (members, and bytes of sets), every pair of tiles to a task of its
own; tasks hand on no pairs but a spanning forest of what they tied or confirmed.

Defined results: a null text, or one without words, has the empty set and is linked with nothing; repeated rows are
copies of each other; rows without a doc_id take part, but name a component only if no row with one is in it, and then
it is null and all its rows are kept; rows of one doc_id with different texts each have their own set; any long is a
doc_id; only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, cut, drop, flat, free_name, groups, lowered, mapped, marked, mix, partitions, slices, span_hashes, word_spans
from .graph import components

WIDTH, HASHES, BITS = 5, 120, 4


class Link(NamedTuple):
    """The similarity of a link as a fraction, the minima of a band and the bands, and the least estimate that is looked at."""

    up: int
    down: int
    rows: int
    bands: int
    estimate: float


#: The links of the query, and those of the pipeline's stage.
QUERY = Link(85, 100, 5, 24, 0.65)
STAGE = Link(80, 100, 4, 30, 0.58)
#: Members and bytes of sets of a tile, and later members that one task compares with one first member.
TILE, TILE_BYTES, PART = 1024, 32 << 20, 256
_CELLS = 16  # 4-bit cells of a word of the packed signature
_ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))
_SHIFTS = mix(np.arange(7, 7 + WIDTH, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all rows, ascending within each, and the rows' offsets."""
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    many, rows = np.diff(first), len(offsets) - 1
    count = np.where(many == 0, 0, np.maximum(1, many - width + 1))
    own = np.repeat(np.arange(rows), count)
    at = np.arange(len(own)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    hashes = np.zeros(len(own), np.uint64)
    last = first[1:][own]
    for k in range(width):
        there = at + k < last
        hashes[there] += words[at[there] + k] * _SHIFTS[k]
    hashes = mix(hashes + np.minimum(many[own], width).astype(np.uint64))
    if rows < 1 << 16:  # sort by row and hash in one key, without losing a bit: rows in order, each sorted
        bounds = np.concatenate([[0], np.cumsum(count)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            hashes[a:b].sort()
    else:
        hashes = hashes[np.lexsort((hashes, own))]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    return hashes[fresh], np.searchsorted(own[fresh], np.arange(rows + 1))


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each row's set, in two halves; zero for the empty set."""
    full = np.flatnonzero(np.diff(bounds))
    out = []
    for seed in (0x1B873593, 0x85EBCA6B):
        key = np.zeros(len(bounds) - 1, np.uint64)
        if len(full):
            key[full] = mix(np.add.reduceat(mix(hashes ^ np.uint64(seed)), bounds[:-1][full]) + np.diff(bounds)[full].astype(np.uint64))
        out.append(key)
    return tuple(out)


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minima of HASHES functions over each row's set (rows x HASHES); rows must not be empty."""
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(((hashes * _ODD[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32), bounds[:-1])
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 16 to a 64-bit word (rows x words)."""
    low = (mix(mins.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint64)
    words = np.zeros((len(mins), -(-HASHES // _CELLS)), np.uint64)
    for i in range(HASHES):
        words[:, i // _CELLS] |= low[:, i] << np.uint64(BITS * (i % _CELLS))
    return words


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (any leading shape x words): the share of equal cells, less what chance gives."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def bands(mins: np.ndarray, link: Link = QUERY) -> np.ndarray:
    """The names of each row's buckets (rows x bands)."""
    out = np.zeros((len(mins), link.bands), np.uint64)
    for i in range(link.bands):
        value = np.full(len(mins), i + 1, np.uint64)
        for j in range(link.rows):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + mins[:, i * link.rows + j].astype(np.uint64))
        out[:, i] = value
    return out


def signatures(df: DataFrame, link: Link = QUERY) -> DataFrame:
    """(doc_id, n, key, check, node, packed, buckets) of each row; packed and buckets are empty where the set is."""
    bounded_batches(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("packed", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = shingles(*flat(part.column(1)))
                key, check = set_keys(hashes, bounds)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                sig, where = [b""] * len(sizes), [[]] * len(sizes)
                if len(full):
                    mins = minima(hashes, np.append(bounds[:-1][full], bounds[-1]))
                    for i, s, w in zip(full.tolist(), packed(mins), bands(mins, link).view(np.int64).tolist()):
                        sig[i], where[i] = s.tobytes(), w
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(sig, pa.binary()), pa.array(where, schema.field("buckets").type)], schema=schema)

    return mapped(df, run, "doc_id long, n long, key long, check long, packed binary, buckets array<long>")


def tiled(members: DataFrame, group: str, node: str, sizes: DataFrame) -> DataFrame:
    """``members`` with a column ``pair`` that names the pairs of tiles of its group which it takes part in; ``sizes`` has the groups' ``tiles``.

    Members of a group in several tiles are dealt by the hash of ``node``; each goes to as many pairs of tiles as its
    group has tiles.
    """
    known = members.join(sizes.withColumnRenamed(group, "of_group"), F.col(group) == F.col("of_group")).drop("of_group")
    tiles = F.col("tiles")
    mine = F.pmod(F.xxhash64(node, group), tiles)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda j: F.least(mine, j) * tiles + F.greatest(mine, j))
    return known.withColumn("pair", F.explode(pairs)).drop("tiles")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links (a, b) among n that tie two parts together, one after the other."""
    parent = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = x, y
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        while parent[q] != q:
            parent[q] = parent[parent[q]]
            q = parent[q]
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _in_groups(df: DataFrame, keys: list[str], values: list[str], links) -> DataFrame:
    """(a, b): for each group of rows of equal ``keys``, the node pairs that ``links(values' columns)`` gives as indexes; the first value is the node."""
    bounded_batches(df.sparkSession)
    dealt = df.select(*keys, *values).repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, values[0])

    def run(batches):
        left, right = [], []
        for parts in groups(batches, len(keys)):
            columns = [pa.chunked_array([p.column(len(keys) + i) for p in parts]).combine_chunks() for i in range(len(values))]
            if len(columns[0]) < 2:
                continue
            nodes = np.asarray(columns[0])
            for x, y in links(columns):
                left.append(nodes[x])
                right.append(nodes[y])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return mapped(dealt, run, "a long, b long")


def _alike(columns: list, link: Link) -> list[tuple[int, int]]:
    """Members of a bucket whose signatures are estimated alike, as a forest."""
    sig = np.frombuffer(b"".join(columns[1].to_pylist()), np.uint64).reshape(len(columns[1]), -1)
    n = len(sig)
    if n == 2:
        return [(0, 1)] if estimates(sig[0], sig[1]) >= link.estimate else []
    a, b = [], []
    for i in range(0, n, 128):
        near = estimates(sig[i : i + 128, None, :], sig[None, :, :]) >= link.estimate
        x, y = np.nonzero(near)
        keep = x + i < y
        a.append(x[keep] + i)
        b.append(y[keep])
    return forest(n, np.concatenate(a), np.concatenate(b))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share (n x n)."""
    n = len(sets)
    own = np.repeat(np.arange(n), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, own = values[order], own[order]
    cuts = np.flatnonzero(np.diff(values)) + 1
    first, size = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(values)]]))
    shared = size > 1
    first, size = first[shared], size[shared]
    held = np.zeros((n, int(len(first))), np.float32) if n * len(first) <= 1 << 24 else None
    total = np.zeros((n, n), np.float32)
    column = np.repeat(np.arange(len(first)), size)
    row = own[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    if held is not None:
        held[row, column] = 1
        return held @ held.T
    block = max(1, (1 << 24) // n)
    for k in range(0, len(first), block):
        held = np.zeros((n, min(block, len(first) - k)), np.float32)
        mine = slice(*np.searchsorted(column, [k, k + block]))
        held[row[mine], column[mine] - k] = 1
        total += held @ held.T
    return total


def similar(a: np.ndarray, b: np.ndarray, link: Link) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return link.down * both >= link.up * (len(a) + len(b) - both)


def _linked(columns: list, link: Link) -> list[tuple[int, int]]:
    """Members of a group, of different parts, whose full sets are similar, as a forest."""
    sets, part = [np.frombuffer(x, np.uint64) for x in columns[1].to_pylist()], np.asarray(columns[2])
    if len(sets) == 2:
        return [(0, 1)] if part[0] != part[1] and similar(*sets, link) else []
    both = overlaps(sets).astype(np.int64)
    sizes = np.array([len(x) for x in sets])
    a, b = np.nonzero(link.down * both >= link.up * (sizes[:, None] + sizes[None, :] - both))
    keep = (a < b) & (part[a] != part[b])
    return forest(len(sets), a[keep], b[keep])


def full_sets(df: DataFrame, wanted) -> DataFrame:
    """(set_key, set_check, words): the sets of rows whose key is marked, one for each class."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = shingles(*flat(part.column(1)))
                key, check = set_keys(hashes, bounds)
                ask = np.flatnonzero((np.diff(bounds) > 0) & wanted.value.has(key))
                yield pa.RecordBatch.from_arrays([pa.array(key[ask].view(np.int64)), pa.array(check[ask].view(np.int64)), pa.array([hashes[bounds[i] : bounds[i + 1]].tobytes() for i in ask.tolist()], pa.binary())], names=["set_key", "set_check", "words"])

    return mapped(df, run, "set_key long, set_check long, words binary").groupBy("set_key", "set_check").agg(F.first("words").alias("words"))


def with_sets(own: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (key, check, ...) with the sets of their classes."""
    wanted = own.sparkSession.sparkContext.broadcast(marked(members.select("key"), lambda part: np.asarray(part.column(0)), members.count()))
    return members.join(full_sets(own, wanted), (F.col("key") == F.col("set_key")) & (F.col("check") == F.col("set_check"))).drop("set_key", "set_check")


def first_links(own: DataFrame, classes: DataFrame, ties: DataFrame, link: Link) -> DataFrame:
    """(a, b): of each class's first tie (a, b), those whose sets are similar. A class that many are tied to is sent once for PART of them."""
    spark = own.sparkSession
    first = ties.groupBy("b").agg(F.min("a").alias("a"))
    many = first.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    target = lambda end, role: F.struct(F.col(end).alias("end"), F.col("a").alias("group"), part.alias("part"), F.lit(role).alias("role"))
    sent = first.join(many, F.col("a") == F.col("of")).select(F.explode(F.array(target("a", 0), target("b", 1))).alias("x")).select("x.*").distinct()
    sent = cut(sent.join(classes.select("key", "check", "node"), F.col("end") == F.col("node")).select("group", "part", "role", "node", "key", "check"))
    dealt = with_sets(own, sent).select("group", "part", "role", "node", "words").repartition(partitions(spark), "group", "part").sortWithinPartitions("group", "part", "role")

    def run(batches):
        last, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for group, piece, role, node, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words = np.frombuffer(raw, np.uint64)
                if not role:
                    last, base = (group, piece), words
                elif last == (group, piece) and similar(base, words, link):
                    left.append(group)
                    right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    out = cut(mapped(dealt, run, "a long, b long"))
    drop(sent)
    return out


def class_roots(own: DataFrame, link: Link) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, n, key, check), and of each class (own_key, own_check, root), the smallest doc_id of its component."""
    rows = cut(signatures(own, link))
    named = rows.where("n > 0").groupBy("key", "check").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("packed").alias("packed"), F.first("buckets").alias("buckets"))
    classes = cut(named.withColumn("node", F.monotonically_increasing_id()))  # fixed once they are written
    entries = classes.select("node", F.explode("buckets").alias("bucket"))
    crowded = cut(entries.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.count("*").alias("size")).where("size > 1").drop("size"))
    members = tiled(entries, "bucket", "node", crowded)
    with_sig = members.join(classes.select(F.col("node").alias("own_node"), "packed"), F.col("node") == F.col("own_node"))
    ties = cut(_in_groups(with_sig, ["bucket", "pair"], ["node", "packed"], lambda columns: _alike(columns, link)).distinct())
    links = [first_links(own, classes, ties, link)]
    parts = components(links[0])
    of_part = lambda end: parts.select(F.col("node").alias(f"{end}_node"), F.col("root").alias(f"{end}_root"))
    between = ties.join(of_part("a"), F.col("a") == F.col("a_node"), "left").join(of_part("b"), F.col("b") == F.col("b_node"), "left")
    between = cut(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a != b").distinct())
    if between.take(1):
        met = components(between)
        in_group = met.select(F.col("node").alias("of_part"), F.col("root").alias("group"))
        in_part = classes.select("key", "check", "node", "n").join(of_part("own"), F.col("node") == F.col("own_node"), "left").withColumn("part", F.coalesce("own_root", "node"))
        placed = cut(in_part.join(in_group, F.col("part") == F.col("of_part")).select("key", "check", "node", "n", "part", "group"))
        sizes = placed.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.col("n") * 8) / TILE_BYTES)).alias("tiles"))
        wide = tiled(with_sets(own, placed), "group", "node", sizes)
        links.append(cut(_in_groups(wide, ["group", "pair"], ["node", "words", "part"], lambda columns: _linked(columns, link))))
        drop(met, placed, parts)
        parts = components(links[0].unionAll(links[1]))
    known = classes.select("key", "check", "node", "first_id").join(parts.withColumnRenamed("node", "own_node"), F.col("node") == F.col("own_node"), "left").withColumn("group", F.coalesce("root", "node"))
    known = cut(known.select("key", "check", "group", "first_id"))
    least = known.groupBy(F.col("group").alias("own_group")).agg(F.min("first_id").alias("least"))
    answer = cut(known.join(least, F.col("group") == F.col("own_group")).select(F.col("key").alias("own_key"), F.col("check").alias("own_check"), F.col("least").alias("root")))
    drop(classes, crowded, ties, between, known, parts, *links)
    return rows.select("doc_id", "n", "key", "check"), answer


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows, answer = class_roots(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), QUERY)
    joined = rows.join(answer, (F.col("key") == F.col("own_key")) & (F.col("check") == F.col("own_check")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return joined.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | F.coalesce(F.col("doc_id") == component, F.lit(False))).alias("kept"))


def keep_one_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", link: Link = STAGE) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with its smallest doc_id.

    Rows go by their doc_id, so repeated rows of the smallest one stay together, and rows without a doc_id stay.
    """
    rows, answer = class_roots(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), link)
    joined = rows.where("n > 0 AND doc_id IS NOT NULL").join(answer.where("root IS NOT NULL"), (F.col("key") == F.col("own_key")) & (F.col("check") == F.col("own_check")))
    name = free_name(df, "gone_doc")
    gone = joined.where("doc_id != root").select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, df[key].cast("long") == F.col(name), "left_anti")
