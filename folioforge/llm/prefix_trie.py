"""Conversation prefix trie by leaf-peeling message passing.

A conversation is rebuilt from the first turns of the first conversation of its hundred and its own later turns. A node
is a distinct sequence of first turns; equal sequences are found by a running XOR of hashes of (place, role, text), 128
bits in all, so nothing but hashes and lengths is moved once the turns are numbered.

Each node belongs to a run: of the conversations that pass through it, the one whose hashed id is least. The nodes of
one run hang together, each the parent of the next, and a run hangs on a node of another run. Leaf-peeling works on runs:
each holds a counter of the runs that hang on it and are not finished; a run whose counter is zero sends its subtree's
totals to its parent, until only the root's run is left. As ids are hashed, runs are in random order, and a path from
the root passes through some ln(n) of n runs, whatever the conversations look like; a chain of turns costs no rounds.
Within a run, totals are sums over all deeper nodes.

Numbering, running XORs and sums over deeper nodes are done in blocks: totals by block first, then what blocks hand on,
then places within a block. So one conversation may hold any share of all turns.

Defined results: rows without a conv_id are left out; null role and text are empty; turns of one number go by role and
text; h is counted on the id in decimal; the hundred's first conversation is conv_id - conv_id % 100, with % taking the
sign of conv_id; a conversation without turns is a member of the root only; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import bounded_batches, cut, drop, mapped, partitions, runs_of

#: Turns of one block of a conversation or run.
BLOCK = 1024


def shared(conv: Column, most: int = 6) -> Column:
    """How many first turns conversation ``conv`` takes from the first one of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % most


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, n_chars) of every turn of (conv, turn, role, text); places from 1 in order of (turn, role, text), nulls first.

    Turns are dealt by ranges, so a conversation may fill many partitions; each numbers its own, and how many stand
    before them in the same conversation is known from one summary row a partition.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    order = ["conv", "turn", "role", "text"]
    dealt = turns.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = dealt.select("conv", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"), F.char_length("text").cast("long").alias("n_chars"))
    schema = pa.schema([("part", pa.int32()), ("conv", pa.int64()), ("place", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_chars", pa.int64())])

    def run(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, n = np.asarray(batch.column(0)), batch.num_rows
            bounds = runs_of(conv)
            starts = np.repeat([a for a, _ in bounds], [b - a for a, b in bounds])
            place = np.arange(n) - starts + 1
            if conv[0] == last:
                place[: bounds[0][1]] += seen
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column(0), pa.array(place), *batch.columns[1:]], schema=schema)

    local = cut(mapped(rows, run, "part int, conv long, place long, h1 long, h2 long, n_chars long"))
    told = local.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "place")).alias("last")).orderBy("part").collect()
    last, seen, more = None, 0, []
    for r in told:
        before = seen if r["first"] == last else 0
        if before:
            more.append((r["part"], r["first"], before))
        last, seen = r["last"]["conv"], r["last"]["place"] + (before if r["last"]["conv"] == r["first"] else 0)
    if not more:
        return local.drop("part")
    known = F.broadcast(spark.createDataFrame(more, "of_part int, of_conv long, before long"))  # a row a partition at most
    joined = local.join(known, (F.col("part") == F.col("of_part")) & (F.col("conv") == F.col("of_conv")), "left")
    return joined.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "h1", "h2", "n_chars")


def running(df: DataFrame, by: str, place: str, columns: list[str], total, ascending: bool = True) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its ``total`` over the rows of ``by`` up to this one by ``place``.

    Within blocks of BLOCK places, and with what the blocks before give; so rows of one ``by`` go to many tasks.
    """
    block = F.floor(F.col(place) / BLOCK)
    direction = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    blocked = df.withColumn("block", block)
    sums = blocked.groupBy(F.col(by).alias("of"), F.col("block").alias("of_block")).agg(*(total(F.col(c)).alias(f"{c}_all") for c in columns))
    earlier = Window.partitionBy("of").orderBy(direction("of_block")).rowsBetween(Window.unboundedPreceding, -1)
    handed = sums.select("of", "of_block", *(total(F.col(f"{c}_all")).over(earlier).alias(f"{c}_before") for c in columns)).where(F.col(f"{columns[0]}_before").isNotNull())
    within = Window.partitionBy(by, "block").orderBy(direction(place)).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.select(*(total(F.col(c)).over(within).alias(c) if c in columns else c for c in blocked.columns))
    joined = local.join(handed, (F.col(by) == F.col("of")) & (F.col("block") == F.col("of_block")), "left")
    both = lambda c: F.when(F.col(f"{c}_before").isNull(), F.col(c)).otherwise(F.col(c).bitwiseXOR(F.col(f"{c}_before")) if total is F.bit_xor else F.col(c) + F.col(f"{c}_before"))
    return joined.select(*(both(c).alias(c) if c in columns else c for c in df.columns))


def rebuilt(turns: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, depth, len, x1, x2, p1, p2, n_chars) of rebuilt conversations with the names of their prefixes and of these without the last turn, and (conv, len) of all conversations."""
    conv = F.col("conv")
    sizes = turns.groupBy("conv").agg(F.max("place").alias("n")).withColumn("h", shared(conv, most)).withColumn("base", conv - conv % 100)
    lends = sizes.where("conv = base").select(F.col("conv").alias("of"), F.least("n", F.lit(most - 1)).alias("lent"))
    taken = F.least("h", F.coalesce("lent", F.lit(0)))
    convs = cut(sizes.join(lends, F.col("base") == F.col("of"), "left").select("conv", "base", "n", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")))
    block = F.floor(F.col("place") / BLOCK)
    # what a turn has to know of its conversation is joined block by block, as one conversation may hold most turns
    spread = convs.select(F.col("conv").alias("of"), "taken", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("of_block"))
    own = turns.where(F.col("place") > shared(conv, most)).withColumn("block", block).join(spread, (conv == F.col("of")) & (F.col("block") == F.col("of_block")))
    own = own.select("conv", (F.col("taken") + F.col("place") - shared(conv, most)).alias("depth"), "len", "h1", "h2", "n_chars")
    first = turns.where((F.col("place") < most) & (conv % 100 == 0)).withColumnRenamed("conv", "of")
    lent = first.join(convs, F.col("of") == F.col("base")).where(F.col("place") <= F.col("taken")).select("conv", F.col("place").alias("depth"), "len", "h1", "h2", "n_chars")
    placed = own.unionAll(lent).select("conv", "depth", "len", F.xxhash64("depth", "h1").alias("h1"), F.xxhash64("depth", "h2").alias("h2"), "n_chars").withColumns({"x1": F.col("h1"), "x2": F.col("h2")})
    named = running(placed, "conv", "depth", ["x1", "x2"], F.bit_xor)
    return named.select("conv", "depth", "len", "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"), "n_chars"), convs


def list_hashes(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of nodes where conversations (conv) end: ids ascending, joined by commas.

    Blocks of ids are joined to texts first; a node's texts are then hashed one after the other, in constant memory.
    """
    spark = ends.sparkSession
    key = ["depth", "x1", "x2"]
    texts = ends.groupBy(*key, F.shiftright("conv", 10).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = texts.repartition(partitions(spark), *key).sortWithinPartitions(*key, "block").select(*key, "ids")
    schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        last, now, out = None, None, []
        for batch in batches:
            for *name, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if name == last:
                    now.update(b",")
                else:
                    if now:
                        out.append((*last, now.hexdigest()))
                    last, now = name, hashlib.sha256()
                now.update(ids.encode())
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if now:
            out.append((*last, now.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return mapped(dealt, run, "depth long, x1 long, x2 long, ends_sha256 string")


def peeled(runs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(run, head_depth, parent_run, leaves, saved) of every run with its subtree's totals, and the tables that it reads.

    ``runs`` have their own totals and ``waiting``, the count of runs that hang on them. In each round the runs that wait
    for none send their totals to their parents.
    """
    tables = [cut(runs)]
    while tables[-1].where("waiting > 0").take(1):
        now = tables[-1]
        sent = now.where("waiting = 0").groupBy(F.col("parent_run").alias("to")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        got = now.where("waiting > 0").join(sent, F.col("run") == F.col("to"), "left")
        tables.append(cut(got.select("run", "head_depth", "parent_run", plus("leaves", "more_leaves"), plus("saved", "more_saved"), (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting"))))
    done = tables[0].where("waiting = 0")
    for t in tables[1:]:
        done = done.unionAll(t.where("waiting = 0"))
    return done.drop("waiting"), tables


def trie(df: DataFrame, most: int = 6) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node; conversations share up to ``most`` - 1 first turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv IS NOT NULL")
    named, convs = rebuilt(numbered(turns), most)
    rows = cut(named)
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.min(F.xxhash64("conv")).alias("run")).first()
    key = ["depth", "x1", "x2"]
    deep = rows.groupBy(*key).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"), F.min(F.xxhash64("conv")).alias("run"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    top = convs.groupBy().agg(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("n_chars"), F.min(F.xxhash64("conv")).alias("run"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2")).where("n_convs > 0")
    nodes = cut(deep.unionByName(top))
    parent = nodes.select((F.col("depth") + 1).alias("of_depth"), F.col("x1").alias("of1"), F.col("x2").alias("of2"), F.col("conv_id").alias("parent_conv_id"), F.col("run").alias("parent_run"))
    first = nodes.where("depth <= 1").withColumns({"parent_conv_id": F.when(F.col("depth") == 1, F.lit(root["conv"]).cast("long")), "parent_run": F.when(F.col("depth") == 1, F.lit(root["run"]).cast("long"))})
    others = nodes.where("depth > 1").join(parent, (F.col("depth") == F.col("of_depth")) & (F.col("p1") == F.col("of1")) & (F.col("p2") == F.col("of2"))).drop("of_depth", "of1", "of2")
    counts = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("of_depth"), F.coalesce("p1", F.lit(0)).alias("of1"), F.coalesce("p2", F.lit(0)).alias("of2")).agg(F.count("*").alias("children"))
    held = first.unionByName(others).join(counts, (F.col("depth") == F.col("of_depth")) & (F.col("x1") == F.col("of1")) & (F.col("x2") == F.col("of2")), "left")
    held = cut(held.select(
        *key, "conv_id", "n_convs", "run", "parent_conv_id", "parent_run", F.coalesce("children", F.lit(0)).alias("n_children"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
    ))
    runs = held.groupBy("run").agg(F.min("depth").alias("head_depth"), F.max(F.when(F.col("parent_run") != F.col("run"), F.col("parent_run"))).alias("parent_run"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    hanging = held.where("parent_run != run").groupBy(F.col("parent_run").alias("to")).agg(F.count("*").alias("waiting"))
    done, tables = peeled(runs.join(hanging, F.col("run") == F.col("to"), "left").select("run", "head_depth", "parent_run", "leaves", "saved", F.coalesce("waiting", F.lit(0)).alias("waiting")))
    hung = done.where("parent_run IS NOT NULL").groupBy(F.col("parent_run").alias("to"), (F.col("head_depth") - 1).alias("at")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    full = held.join(hung, (F.col("run") == F.col("to")) & (F.col("depth") == F.col("at")), "left").select(*key, "conv_id", "n_convs", "run", "parent_conv_id", "n_children", plus("leaves", "more_leaves"), plus("saved", "more_saved"))
    full = cut(running(full, "run", "depth", ["leaves", "saved"], F.sum, ascending=False))
    ends = rows.where("depth = len").select(*key, "conv").unionByName(convs.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "conv"))
    hashes = list_hashes(ends).select(F.col("depth").alias("of_depth"), F.col("x1").alias("of1"), F.col("x2").alias("of2"), "ends_sha256")
    out = full.join(hashes, (F.col("depth") == F.col("of_depth")) & (F.col("x1") == F.col("of1")) & (F.col("x2") == F.col("of2")), "left")
    out = cut(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    drop(rows, convs, nodes, held, full, *tables)
    return out


def trie_sql(most: int = 6) -> str:
    """The same in SQL: nodes by lists of turns, subtrees by joining every node with its ancestors; CRC-32 bit by bit."""
    return f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda state, byte: list_reduce(list_prepend(xor(state, byte), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) % {most} AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
lists AS (SELECT conv_id, list(said ORDER BY place) AS said FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT l.conv_id, list_concat(list_slice(coalesce(b.said, []), 1, h), list_slice(l.said, h + 1, len(l.said))) AS said
  FROM lists l JOIN crc USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 100),
paths AS (SELECT conv_id, d, list_slice(said, 1, d) AS node, len(said) AS n FROM rebuilt, unnest(range(0, len(said) + 1)) AS u(d)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(node[d].text) END AS saved,
    sha256(coalesce(string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM paths GROUP BY node, d),
children AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT m.*, coalesce(c.n, 0) AS n_children FROM nodes m LEFT JOIN children c ON c.node = m.node),
totals AS (
  SELECT list_slice(node, 1, a) AS node, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM counted, unnest(range(0, d + 1)) AS u(a) GROUP BY 1)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN totals s ON s.node = c.node LEFT JOIN nodes p ON c.d > 0 AND p.node = list_slice(c.node, 1, c.d - 1)
"""
