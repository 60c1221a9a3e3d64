"""N-gram Jaccard join by PartEnum signatures, exact.

A document is the set of its runs of five words; equal sets are one class. Sizes fall into bands, each as wide as the
similarity allows, so that linked sets are in one band or in neighbouring ones. For each such pair of bands there is a
largest Hamming distance k that linked sets may have. The feature domain is parted into n1 parts by hash and each part
into three; linked sets differ by at most one feature in at least n1 - k/2 parts, and there the features of two of the
three sub-parts are equal. A signature is the hash of the features in two sub-parts of a part (for small k: of a whole
part, n1 > k). So sufficiently similar sets share a signature, with certainty.

Signatures without any feature would be shared by unrelated sets. They are left out where that is safe: if a set has
fewer parts with such a signature than parts that must agree, it shares one with features with each of its partners.
A set for which that fails takes further partings of the domain until it holds in one; both sets of a pair are in all
partings up to the one where it holds for either. After PARTINGS of them all signatures count.

Sets with a common signature are a bucket. Each bucket's first set is paired with the others. Pairs whose parity
sketches differ in more bits than linked sets may in features are surely none; the others are confirmed on full sets,
for each set the pair with most common signatures first. In buckets whose members are then in several components the
sketches of all members of different components are compared in tiles. First a forest of the possible pairs is confirmed,
so few that a tile gives less of them than it has members; where there are more and the components are still apart, all
that are left. The confirmed links make the components.

Defined results: a null text, or one without words, has the empty set and is linked with nothing; repeated rows are
copies of each other; rows without a doc_id take part, but name a component only if no row with one is in it, and then
it is null; rows of one doc_id with different texts each have their own set; only the named columns are read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, cut, drop, flat, mapped, marked, mix, partitions, slices
from .graph import components
from .minhash_dedup import TILE, TILE_BYTES, Link, _in_groups, forest, set_keys, shingles, similar, tiled

#: Links of the query: similarity as a fraction (the other fields are for MinHash only).
QUERY = Link(80, 100, 0, 0, 0.0)
#: Partings of the domain after which signatures without features count too, and Hamming distance from which parts are parted again.
PARTINGS, DEEP = 32, 8
#: Members of a bucket that are held together to name it by its list, and later members that one task compares with one first member.
LIST, PART = 1 << 16, 256
_SEEDS = mix(np.arange(2001, 2001 + PARTINGS, dtype=np.uint64))
_SUBSETS = {1: [(0,)], 3: [(0, 1), (0, 2), (1, 2)]}


class Bands(NamedTuple):
    """Of each size band: its least and largest size, the Hamming distance of links with the band below or within it, its parts, and sub-parts of a part."""

    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    subs: np.ndarray


def bands(link: Link, largest: int) -> Bands:
    low, high = [1], [link.down // link.up]
    while high[-1] < 2 * largest:
        low.append(high[-1] + 1)
        high.append(low[-1] * link.down // link.up)
    top = np.array(high)
    far = 2 * top * (link.down - link.up) // (link.down + link.up)
    deep = far >= DEEP
    parts = np.where(deep, far // 2 + 2 + far // 16, far + 1 + (far + 7) // 8)
    return Bands(np.array(low), top, np.where(far == 0, 0, parts), np.where(deep, 3, 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray, link: Link) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of the sets of all rows."""
    sizes = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = bands(link, int(sizes.max()))
    own = np.searchsorted(b.low, sizes, side="right") - 1
    out, rows = [], []
    for step in (0, 1):  # with the band below or within the band, and with the band above
        level = own + step
        for subs in (1, 3):
            left = np.flatnonzero((sizes > 0) & (b.parts[level] > 0) & (b.subs[level] == subs))
            for parting in range(PARTINGS):
                if not len(left):
                    break
                found, row, left = _parted(hashes, bounds, sizes, left, level, b, subs, parting, link)
                out.append(found)
                rows.append(row)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _parted(hashes, bounds, sizes, chosen, level, b: Bands, subs: int, parting: int, link: Link):
    """The signatures of one parting of the domain, and the rows for which it does not do."""
    many, parts = sizes[chosen], b.parts[level[chosen]]
    first = np.cumsum(parts) - parts  # each row's parts lie end to end
    at = np.arange(int(many.sum())) + np.repeat(bounds[chosen] - (np.cumsum(many) - many), many)
    values = hashes[at]
    placed = mix(values + _SEEDS[parting])
    cell = np.repeat(first * subs, many) + (placed % np.repeat((parts * subs).astype(np.uint64), many)).astype(np.int64)
    total = int(parts.sum())
    counts = np.bincount(cell, minlength=total * subs).reshape(total, subs)
    order = np.argsort(cell, kind="stable")
    sums = np.zeros(total * subs, np.uint64)
    filled = np.flatnonzero(counts.ravel())
    sums[filled] = np.add.reduceat(mix(values ^ np.uint64(0x1B873593))[order], np.cumsum(counts.ravel())[filled] - counts.ravel()[filled])
    sums = sums.reshape(total, subs)
    owner = np.repeat(np.arange(len(chosen)), parts)
    number = np.arange(total) - first[owner]
    label = (level[chosen][owner].astype(np.uint64) << np.uint64(40)) + (number.astype(np.uint64) << np.uint64(8)) + np.uint64(parting * 4)
    picked = _SUBSETS[subs]
    features = np.stack([counts[:, list(s)].sum(axis=1) for s in picked], axis=1)
    names = np.stack([mix(mix(sums[:, list(s)].sum(axis=1, dtype=np.uint64)) + mix(label + np.uint64(i))) for i, s in enumerate(picked)], axis=1)
    poor = np.bincount(owner[(features == 0).any(axis=1)], minlength=len(chosen))
    size, top = sizes[chosen], b.high[level[chosen]]
    apart = (size + np.minimum(size * link.down // link.up, top)) * (link.down - link.up) // (link.down + link.up)
    agreeing = parts - (apart // 2 if subs == 3 else apart)  # so many parts at least hold a common signature
    done = agreeing > poor
    wanted = features > 0
    if parting == PARTINGS - 1:
        wanted |= ~done[owner][:, None]
    where = np.broadcast_to(chosen[owner][:, None], wanted.shape)
    return names[wanted], where[wanted], chosen[~done]


def _sets(batch: pa.RecordBatch, column: int):
    for part in slices(batch, batch.schema.names[column]):
        yield part, *shingles(*flat(part.column(column)))


def named(df: DataFrame) -> DataFrame:
    """(doc_id, n, key, check, text) of each row: the size and the 128-bit name of its set."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part, hashes, bounds in _sets(batch, 1):
                key, check = set_keys(hashes, bounds)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), part.column(1)], names=["doc_id", "n", "key", "check", "text"])

    return mapped(df, run, "doc_id long, n long, key long, check long, text string")


def signed(classes: DataFrame, link: Link) -> DataFrame:
    """(sig, node) of all signatures of the classes."""
    bounded_batches(classes.sparkSession)

    def run(batches):
        for batch in batches:
            for part, hashes, bounds in _sets(batch, 1):
                found, row = signatures(hashes, bounds, link)
                nodes = np.asarray(part.column(0))[row]
                for i in range(0, len(found), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 18)].view(np.int64)), pa.array(nodes[i : i + (1 << 18)])], names=["sig", "node"])

    return mapped(classes.select("node", "text"), run, "sig long, node long")


def buckets(signed_classes: DataFrame) -> DataFrame:
    """(bucket, a, b, n): the first member a and each other member b of all buckets; n buckets have the same name.

    A bucket of two has the name 0. Others are named by the list of their members, so that buckets of the same members
    are one; a bucket of over LIST members goes by its signature.
    """
    spark = signed_classes.sparkSession
    dealt = signed_classes.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "node")

    def whole(sig, node):
        """Rows of whole buckets."""
        start = np.concatenate([[True], sig[1:] != sig[:-1]])
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(sig)))
        own = np.repeat(np.arange(len(at)), size)
        listed = np.add.reduceat(mix(node.astype(np.uint64)), at) | np.uint64(1)
        name = np.where(size > 2, listed, 0)[own]
        keep = ~start & (size > 1)[own]
        return name[keep].view(np.int64), node[at][own][keep], node[keep]

    def run(batches):
        sig, node, open_sig, first = np.zeros(0, np.int64), np.zeros(0, np.int64), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node = np.concatenate([sig, np.asarray(batch.column(0))]), np.concatenate([node, np.asarray(batch.column(1))])
            if open_sig is not None:  # more of a bucket that is handed on as it comes
                n = int(np.searchsorted(sig, open_sig, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, open_sig)), pa.array(np.full(n, first)), pa.array(node[:n])], names=["bucket", "a", "b"])
                sig, node = sig[n:], node[n:]
                if not len(sig):
                    continue
                open_sig = None
            n = int(np.searchsorted(sig, sig[-1]))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole(sig[:n], node[:n])], names=["bucket", "a", "b"])
            sig, node = sig[n:], node[n:]
            if len(sig) > LIST:
                open_sig, first = sig[0], node[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node) - 1, open_sig)), pa.array(np.full(len(node) - 1, first)), pa.array(node[1:])], names=["bucket", "a", "b"])
                sig, node = sig[:0], node[:0]
        if len(sig):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole(sig, node)], names=["bucket", "a", "b"])

    return mapped(dealt, run, "bucket long, a long, b long").groupBy("bucket", "a", "b").agg(F.count("*").alias("n"))


def of_nodes(classes: DataFrame, pairs: DataFrame, made: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(of_node, words): what is ``made`` of the sets of the classes in ``pairs`` (a, b), a written table (and, by chance, of a few others)."""
    spark = classes.sparkSession
    bounded_batches(spark)
    ends = pairs.select("a", "b")
    wanted = spark.sparkContext.broadcast(marked(ends, lambda part: np.concatenate([np.asarray(part.column(0)), np.asarray(part.column(1))]), pairs.count()))

    def run(batches):
        for batch in batches:
            asked = batch.filter(pa.array(wanted.value.has(np.asarray(batch.column(0)))))
            for part, hashes, bounds in _sets(asked, 1) if asked.num_rows else ():
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([made(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["of_node", "words"])

    return mapped(classes.select("node", "text"), run, "of_node long, words binary")


def sketch(words: np.ndarray) -> bytes:
    """A set's size and its parity sketch: of each of some 2 to 4 bits a feature, whether an odd number of features falls on it.

    Two sketches differ in no more bits than their sets in features, so a pair that differs in more than linked sets may
    is surely none. Folding the halves of a sketch together gives the one of half the size.
    """
    bits = max(256, 1 << int(2 * len(words) - 1).bit_length())
    out = np.zeros(bits // 64 + 1, np.uint64)
    at = words & np.uint64(bits - 1)
    np.bitwise_xor.at(out, (at >> np.uint64(6)).astype(np.int64) + 1, np.uint64(1) << (at & np.uint64(63)))
    out[0] = len(words)
    return out.tobytes()


def folded(one: np.ndarray, words: int) -> np.ndarray:
    while len(one) > words:
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return one


def may_link(a: np.ndarray, b: np.ndarray, link: Link) -> bool:
    """Whether two sets of such sketches can be similar."""
    n, m = int(a[0]), int(b[0])
    words = min(len(a), len(b)) - 1
    apart = int(np.bitwise_count(folded(a[1:], words) ^ folded(b[1:], words)).sum())
    return link.down * min(n, m) >= link.up * max(n, m) and apart * (link.down + link.up) <= (n + m) * (link.down - link.up)


def _candidates(columns: list, link: Link, every: bool) -> list[tuple[int, int]]:
    """Pairs of members of a bucket, of different components, that may be linked: all, or so few that they tie all components together that may be tied.

    In the second case a member paired with itself says that there are more.
    """
    held, part = [np.frombuffer(x, np.uint64) for x in columns[1].to_pylist()], np.asarray(columns[2])
    _, part = np.unique(part, return_inverse=True)
    sizes = np.array([int(x[0]) for x in held])
    words = min(len(x) for x in held) - 1
    bits = np.stack([folded(x[1:], words) for x in held])
    left, right = [], []
    step = max(1, (1 << 22) // (len(held) * words))
    for i in range(0, len(held), step):
        mine = slice(i, i + step)
        apart = np.bitwise_count(bits[mine, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
        both = sizes[mine, None] + sizes[None, :]
        near = (apart * (link.down + link.up) <= both * (link.down - link.up)) & (part[mine, None] < part[None, :])
        near &= link.down * np.minimum(sizes[mine, None], sizes[None, :]) >= link.up * np.maximum(sizes[mine, None], sizes[None, :])
        x, y = np.nonzero(near)
        left.append(x + i)
        right.append(y)
    a, b = np.concatenate(left), np.concatenate(right)
    if every:
        return list(zip(a.tolist(), b.tolist()))
    _, first = np.unique(part[a].astype(np.int64) * len(part) + part[b], return_index=True)  # one pair for each two components
    of = {(part[x], part[y]): (x, y) for x, y in zip(a[first].tolist(), b[first].tolist())}
    tied = [of[t] for t in forest(len(part), part[a[first]], part[b[first]])]
    return tied + [(0, 0)] if len(tied) < len(a) else tied


def tested(pairs: DataFrame, values: DataFrame, test: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """(a, b): those of the ``pairs`` (a, b) whose ``values`` (of_node, words) pass. A class in very many pairs is sent once for PART of them."""
    spark = pairs.sparkSession
    bounded_batches(spark)
    many = pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    target = lambda end, role: F.struct(F.col(end).alias("node"), F.col("a").alias("group"), part.alias("part"), F.lit(role).alias("role"))
    sent = pairs.join(many, F.col("a") == F.col("of")).select(F.explode(F.array(target("a", 0), target("b", 1))).alias("x")).select("x.*").distinct()
    dealt = sent.join(values, F.col("node") == F.col("of_node")).select("group", "part", "role", "node", "words").repartition(partitions(spark), "group", "part").sortWithinPartitions("group", "part", "role")

    def run(batches):
        last, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for group, piece, role, node, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                words = np.frombuffer(raw, np.uint64)
                if not role:
                    last, base = (group, piece), words
                elif last == (group, piece) and test(base, words):
                    left.append(group)
                    right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return cut(mapped(dealt, run, "a long, b long"))


def confirmed(classes: DataFrame, pairs: DataFrame, link: Link) -> DataFrame:
    """(a, b): those of the ``pairs`` (a, b), a written table, whose full sets are similar."""
    return tested(pairs, of_nodes(classes, pairs, lambda words: words.tobytes()), lambda a, b: similar(a, b, link))


def with_parts(df: DataFrame, column: str, parts: DataFrame, name: str) -> DataFrame:
    """``df`` with the component of the node in ``column``."""
    return df.join(parts.select(F.col("node").alias(f"of_{name}"), F.col("root").alias(name)), F.col(column) == F.col(f"of_{name}"), "left").drop(f"of_{name}").withColumn(name, F.coalesce(name, column))


def linked(classes: DataFrame, link: Link) -> DataFrame:
    """(node, root) of all classes (node, n, text) that are linked with others."""
    shared = cut(buckets(signed(classes, link)))
    sketches = cut(of_nodes(classes, shared, sketch))
    counted = cut(shared.groupBy("a", "b").agg(F.sum("n").alias("n")))
    likely = tested(counted.select("a", "b"), sketches, lambda a, b: may_link(a, b, link))
    ties = cut(likely.withColumnsRenamed({"a": "of_a", "b": "of_b"}).join(counted, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b"))).select("a", "b", "n"))
    best = cut(ties.groupBy("b").agg(F.max(F.struct(F.col("n"), -F.col("a"))).alias("x")).select((-F.col("x")["col2"]).alias("a"), "b"))
    links = [confirmed(classes, best, link)]
    parts = components(links[0])
    drop(likely, counted)
    # the other pairs with a first member, and members of a bucket that are in different components
    apart = with_parts(with_parts(ties, "a", parts, "part_a"), "b", parts, "part_b").where("part_a != part_b").select("a", "b")
    rest = apart.join(best.withColumnsRenamed({"a": "of_a", "b": "of_b"}), (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")), "left_anti")
    for every in (False, True):
        members = cut(unsettled(shared, classes, parts))
        sizes = members.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_BYTES)).alias("tiles"))
        full = tiled(members, "bucket", "node", sizes).join(sketches, F.col("node") == F.col("of_node"))
        met = _in_groups(full, ["bucket", "pair"], ["node", "words", "part"], lambda columns, every=every: _candidates(columns, link, every))
        pairs = cut((met if every else met.unionAll(rest)).distinct())
        if pairs.where("a != b").take(1):
            links.append(confirmed(classes, pairs, link))
            if links[-1].take(1):
                drop(parts)
                parts = components(all_of(links))
        more = pairs.where("a = b").take(1)
        drop(members, pairs)
        if not more:
            break
    drop(shared, sketches, ties, best, *links)
    return parts


def all_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionAll(more)
    return out


def unsettled(shared: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """(bucket, node, part, n): the members, with their components, of buckets in which there are several."""
    wide = shared.where("bucket != 0").select("bucket", F.explode(F.array("a", "b")).alias("node")).distinct()
    placed = with_parts(wide, "node", parts, "part")
    apart = placed.groupBy(F.col("bucket").alias("of")).agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least != most").select("of")
    sizes = classes.select(F.col("node").alias("own_node"), "n")
    return placed.join(apart, F.col("bucket") == F.col("of"), "left_semi").join(sizes, F.col("node") == F.col("own_node")).select("bucket", "node", "part", "n")


def joined(df: DataFrame, text: str = "text", key: str = "doc_id", link: Link = QUERY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    own = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = cut(named(own).drop("text"))
    grouped = named(own).where("n > 0").groupBy("key", "check").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("text").alias("text"))
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))  # fixed once they are written
    parts = linked(classes, link)
    known = with_parts(classes.select("key", "check", "node", "first_id"), "node", parts, "root")
    least = known.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("component"))
    answer = cut(known.join(least, F.col("root") == F.col("of")).select(F.col("key").alias("own_key"), F.col("check").alias("own_check"), "component"))
    drop(classes, parts)
    out = rows.join(answer, (F.col("key") == F.col("own_key")) & (F.col("check") == F.col("own_check")) & (F.col("n") > 0), "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def joined_sql(link: Link = QUERY, kept: bool = False) -> str:
    """The same in SQL: classes joined by every common shingle, then the closure of the links."""
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
sets AS (SELECT rid, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS name FROM shingles GROUP BY rid),
classes AS (SELECT name, min(rid) AS rid, any_value(n) AS n FROM sets GROUP BY name),
held AS (SELECT c.rid, s.s FROM classes c JOIN shingles s USING (rid)),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM held a JOIN held b ON a.s = b.s AND a.rid < b.rid JOIN classes x ON x.rid = a.rid JOIN classes y ON y.rid = b.rid
  GROUP BY a.rid, b.rid, x.n, y.n HAVING {link.down} * count(*) >= {link.up} * (x.n + y.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(rid, other) AS (SELECT rid, rid FROM classes UNION SELECT r.rid, b.b FROM reached r JOIN pairs b ON b.a = r.other),
least AS (SELECT c.name, min(d.doc_id) AS doc_id FROM classes c JOIN sets s USING (name) JOIN d ON d.rid = s.rid GROUP BY c.name),
roots AS (SELECT c.name, min(l.doc_id) AS root FROM classes c JOIN reached r ON r.rid = c.rid JOIN classes o ON o.rid = r.other JOIN least l ON l.name = o.name GROUP BY c.name)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.n IS NULL THEN d.doc_id ELSE r.root END AS component_id{", coalesce(CASE WHEN s.n IS NULL THEN d.doc_id ELSE r.root END = d.doc_id, true) AS kept" if kept else ""}
FROM d LEFT JOIN sets s ON s.rid = d.rid LEFT JOIN roots r ON r.name = s.name
"""
