"""Gap sessionisation: clicks cut into sessions by final clicks, gaps and a greatest length.

Clicks are taken once per click_id and dealt by ranges of (client, time, click), so that one client may fill many
partitions. Within a partition islands (runs of a client's timely clicks without a final click or a gap between them)
lie end to end in numpy arrays, and all islands still open advance by one session a step: one searchsorted over
composite keys (island, time) finds each one's first click beyond the greatest length. There is no loop over clients.

A partition does not know what came before it. Its head, the first client's rows up to the first click that surely
starts a session, is set aside; everything else is done in the same pass. One summary row a partition (as many rows as
the range bounds that Spark itself keeps in the driver) tells each head which session is open where it begins. A head
that fills its partition hands the open session on, and which one it hands on depends on the one it gets: it is then a
step function of that session's start. If such a function is not constant it stays in a table, and the chain of them is
composed by doubling: after k joins each partition knows the outcome of the 2^k partitions before it. Sessions that
reach over a border are pieces, added up at the end.

Defined results: rows without click_id, client or time are left out; of repeated click_ids that differ the least row by
(client, time, late, value, final) counts; a null arrival is timely; a null, NaN or infinite value adds nothing beyond
what floor gives it as a long (NaN: 0); late clicks before a client's first session are counted nowhere; a client with
late clicks only has no session; clicks of one time go by click_id, and a late click belongs to the session of a timely
one of the same time; no rows give no sessions; only the named columns are read. The texts of a session's path are
hashed in the task that holds it, as a hash has to read them in order.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, cut, drop, groups, mapped, partitions

MINUTE = 60_000_000


class Rules(NamedTuple):
    """Microseconds after which a click is late, that end a session as a gap, and that a session may last; what makes a click final."""

    late: int = 360 * MINUTE
    gap: int = 10 * MINUTE
    length: int = 40 * MINUTE
    final_kind: str = "error"
    final_value: float = 60.0


REASONS = [None, "end", "gap", "length", "none"]
_FAR = np.iinfo(np.int64)
_OUT = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("client_id", pa.int64()), ("session_id", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("n_clicks", pa.int64()), ("n_late", pa.int64()),
    ("value_cents", pa.int64()), ("closed_by", pa.string()), ("final", pa.bool_()), ("late", pa.bool_()), ("path", pa.string()),
])
_DDL = "kind string, part int, client_id long, session_id long, start_us long, end_us long, n_clicks long, n_late long, value_cents long, closed_by string, final boolean, late boolean, path string"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without a zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def timed(df: DataFrame, rules: Rules) -> DataFrame:
    """(client_id, ts_us, late, click_id, cents, final) of each click once."""
    ts, arrived = micros(df, "ts"), micros(df, "arrived_at")
    rows = df.select(
        F.col("client_id").cast("long").alias("client_id"), ts.alias("ts_us"), F.coalesce(arrived - ts > rules.late, F.lit(False)).alias("late"), F.col("click_id").cast("long").alias("click_id"),
        F.coalesce(F.floor(F.col("value") * 100 + 0.5), F.lit(0)).cast("long").alias("cents"), F.coalesce((F.col("kind") == rules.final_kind) & (F.col("value") >= rules.final_value), F.lit(False)).alias("final"),
    ).where("client_id IS NOT NULL AND ts_us IS NOT NULL AND click_id IS NOT NULL")
    return rows.groupBy("click_id").agg(F.min(F.struct("client_id", "ts_us", "late", "cents", "final")).alias("x")).select("x.client_id", "x.ts_us", "x.late", "click_id", "x.cents", "x.final")


def lockstep(ts: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The indexes of all session starts, ascending, given the islands' starts; times ascend within an island."""
    if not len(starts):
        return starts
    ends = np.append(starts[1:], len(ts))
    first = ts[starts]
    base = np.concatenate([[0], np.cumsum(ts[ends - 1] - first + length + 1)[:-1]])
    island = np.repeat(np.arange(len(starts)), ends - starts)
    key = np.full(len(ts), -1, np.int64)
    key[starts[0] :] = ts[starts[0] :] - first[island] + base[island]
    found, at, end = [starts], starts, ends
    while len(at):
        following = np.searchsorted(key, key[at] + length, side="right")
        going = following < end
        at, end = following[going], end[going]
        found.append(at)
    return np.sort(np.concatenate(found))


class Clicks:
    """Clicks in order of (client, time, late, click) as arrays, and the running sums that sessions are read from."""

    def __init__(self, client, ts, late, click, cents, final):
        self.client, self.ts, self.late, self.click, self.cents, self.final = client, ts, late, click, cents, final
        self.n = len(ts)
        self.timely = np.flatnonzero(~late)
        self.before = np.concatenate([[0], np.cumsum(~late)])  # timely clicks before each place
        self.sums = np.concatenate([[0], np.cumsum(np.where(late, 0, cents))])

    @functools.cached_property
    def ids(self) -> pa.Array:
        """The timely clicks' ids as text."""
        return pa.array(self.click[self.timely]).cast(pa.string())

    def sliced(self, a: int, b: int) -> Clicks:
        return Clicks(*(x[a:b] for x in (self.client, self.ts, self.late, self.click, self.cents, self.final)))

    def reasons(self, gap: int) -> np.ndarray:
        """For each timely click: 1 or 2 if the timely one before it ends a session by `end` or `gap`, 4 at a client's first, else 0."""
        t = self.timely
        out = np.full(len(t), 4, np.int8)
        same = self.client[t[1:]] == self.client[t[:-1]]
        out[1:][same] = np.where(self.final[t[:-1]], 1, np.where(self.ts[t[1:]] - self.ts[t[:-1]] >= gap, 2, 0))[same]
        return out

    def rows(self, kind: str, part: int, starts: np.ndarray, stops: np.ndarray, closed: np.ndarray, hashed: bool, named: tuple[int, int] | None = None) -> pa.RecordBatch:
        """Sessions of the rows [start, stop); ``named`` gives the (start_us, session_id) of a session that began elsewhere."""
        a, b = self.before[starts], self.before[stops]
        last = self.timely[np.maximum(b - 1, 0)] if len(self.timely) else np.zeros(len(starts), np.int64)
        some = b > a
        # each session's clicks stand together: a list for each
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(b - a)]), pa.int32()), self.ids.take(pa.array(np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum())))))
        path = pc.binary_join(lists, ",")
        if hashed:
            path = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in path.to_pylist()], pa.string())
        n = len(starts)
        return pa.RecordBatch.from_arrays([
            pa.array([kind] * n, pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(self.client[starts]),
            pa.array(self.click[starts]) if named is None else pa.array([named[1]] * n, pa.int64()), pa.array(self.ts[starts]) if named is None else pa.array([named[0]] * n, pa.int64()),
            pa.array(np.where(some, self.ts[last], 0), pa.int64(), mask=~some), pa.array(b - a, pa.int64()), pa.array((stops - starts) - (b - a), pa.int64()), pa.array(self.sums[stops] - self.sums[starts], pa.int64()),
            pa.array([REASONS[x] for x in closed.tolist()], pa.string()), pa.array(self.final[last], pa.bool_(), mask=~some), pa.nulls(n, pa.bool_()), path,
        ], schema=_OUT)

    def sessions(self, part: int, why: np.ndarray, first: int, rules: Rules, after: int, still_open: bool):
        """All sessions of the timely clicks from number ``first`` on, where ``why`` tells what starts an island.

        ``after`` is what closes the last session (4: nothing, as its client ends); the last is a piece if it is ``still_open``.
        """
        t = self.timely
        if first >= len(t):
            return
        islands = first + np.flatnonzero(why[first:] > 0)
        starts = lockstep(self.ts[t], islands, rules.length)
        reason = np.where(why[starts] > 0, why[starts], 3)
        at = t[starts]
        # a session takes what stands up to the next one of its client, late clicks too
        client_ends = np.append(np.flatnonzero(self.client[1:] != self.client[:-1]) + 1, self.n)
        stops = np.minimum(np.append(at[1:], self.n), client_ends[np.searchsorted(client_ends, at, side="right")])
        closed = np.append(reason[1:], after)
        ends = np.flatnonzero(closed == 4)
        closed[ends] = np.where(self.final[t[self.before[stops[ends]] - 1]], 1, 4)
        if still_open:
            yield self.rows("piece", part, at[-1:], stops[-1:], np.zeros(1, np.int8), False)
            at, stops, closed = at[:-1], stops[:-1], closed[:-1]
        for i in range(0, len(at), 1 << 16):
            yield self.rows("session", part, at[i : i + (1 << 16)], stops[i : i + (1 << 16)], closed[i : i + (1 << 16)], True)


def _whole(batches: list[pa.RecordBatch], names: list[str]) -> Clicks:
    columns = pa.Table.from_batches(batches)
    return Clicks(*(columns.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in names))


def _told(kind: str, part: int, **values) -> pa.RecordBatch:
    """A row about a partition in the columns of sessions; lists give several rows."""
    n = max((len(v) for v in values.values() if isinstance(v, np.ndarray)), default=1)
    fixed = {"kind": [kind] * n, "part": [part] * n}
    return pa.RecordBatch.from_arrays([pa.array(x if (x := (fixed | values).get(f.name)) is not None and not np.isscalar(x) else [x] * n, f.type) for f in _OUT], schema=_OUT)


def hand_over(ts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which session is open behind the timely clicks ``ts`` of one island, by the start of the session open before them.

    Gives (low, high, last): a start in [low, high) leaves the session that starts with click number ``last`` open, or
    itself where that is -1.
    """
    many = int(np.searchsorted(ts, ts[0] + length, side="right"))
    first = np.arange(many + (many < len(ts)))  # the click that may be the first beyond the open session's length
    at = first.copy()
    going = np.arange(len(at))
    while len(going):
        following = np.searchsorted(ts, ts[at[going]] + length, side="right")
        going, following = going[following < len(ts)], following[following < len(ts)]
        at[going] = following
    low = np.concatenate([[_FAR.min], ts[first[1:] - 1] - length]) if len(first) else np.zeros(0, np.int64)
    if many == len(ts):
        low, at = np.append(low, ts[-1] - length), np.append(at, -1)
    fresh = np.concatenate([[True], at[1:] != at[:-1]])
    low, at = low[fresh], at[fresh]
    return low, np.append(low[1:], _FAR.max), at


def _first_pass(rules: Rules):
    names = ["client_id", "ts_us", "late", "click_id", "cents", "final"]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part, d = TaskContext.get().partitionId(), _whole(held, names)
        del held
        why = d.reasons(rules.gap)
        own = d.client[d.timely] == d.client[0]
        sure = np.flatnonzero(own & (why > 0))
        sure = sure[sure > 0]  # the first client's first timely click depends on what came before
        change = np.flatnonzero(d.client != d.client[0])
        end = min(int(change[0]) if len(change) else d.n, int(d.timely[sure[0]]) if len(sure) else d.n)
        spans, head = end == d.n, d.sliced(0, end)
        close = int(why[sure[0]]) if not spans and len(sure) and d.timely[sure[0]] == end else 0
        tail = d.timely[d.client[d.timely] == d.client[-1]]
        goes_on = not spans and len(tail) > 0
        yield from d.sessions(part, why, int(d.before[end]), rules, 0 if goes_on else 4, goes_on)
        for i in range(0, end, 1 << 16):
            x = head.sliced(i, min(end, i + (1 << 16)))
            yield _told("head", part, client_id=x.client, session_id=x.click, start_us=x.ts, value_cents=x.cents, final=x.final, late=x.late)
        # what the next partition has to know; columns by what they hold here: end_us is the last timely click, n_clicks the open session's click
        known = {"client_id": int(d.client[0]), "session_id": int(d.client[-1]), "n_late": close, "late": spans}
        if len(head.timely):
            known["start_us"] = int(head.ts[head.timely[0]])
        if len(tail):
            known |= {"end_us": int(d.ts[tail[-1]]), "final": bool(d.final[tail[-1]])}
        if spans and len(tail):
            times = d.ts[d.timely]
            low, high, last = hand_over(times, rules.length)
            fresh = d.timely[lockstep(times, np.zeros(1, np.int64), rules.length)[-1]]
            known |= {"value_cents": int(d.ts[fresh]), "n_clicks": int(d.click[fresh]), "closed_by": "one" if len(last) == 1 and last[0] >= 0 else "many"}
            if known["closed_by"] == "one":
                yield _told("open", part, start_us=int(times[last[0]]), session_id=int(d.click[d.timely[last[0]]]))
            else:
                at = d.timely[np.maximum(last, 0)]
                yield _told("step", part, start_us=low, end_us=high, value_cents=d.ts[at], session_id=d.click[at], late=last < 0)
        yield _told("part", part, **known)

    return run


def _second_pass(entries: dict, rules: Rules):
    """Heads, each with what is known of it: (start_us, session_id) of the open session or None, what closes it first, what closes the head, whether it fills its partition."""

    def run(batches):
        for held in groups(batches, 1):
            d = _whole(held, ["client_id", "start_us", "late", "session_id", "value_cents", "final"])
            part = held[0].column(0)[0].as_py()
            opened, broken, close, spans = entries[part]
            times = d.ts[d.timely]
            first = 0
            if opened and not broken:
                first = int(np.searchsorted(times, opened[0] + rules.length, side="right"))
            why = np.zeros(len(times), np.int8)
            if first < len(times):
                why[first] = broken or (3 if opened else 4)
            if opened:
                stop = d.timely[first] if first < len(times) else d.n
                closed = why[first] if first < len(times) else close
                yield d.rows("piece", part, np.zeros(1, np.int64), np.array([stop]), np.array([closed if closed < 4 else 0]), False, opened)
            yield from d.sessions(part, why, first, rules, 0 if spans else close or 4, spans)

    return run


def _composed(then: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """Step functions one after the other; where there is none before, ``then`` alone."""
    if not len(before) or not len(then):
        return then
    then, before = then.sort_values("low"), before.sort_values("low")
    low, high = then["low"].to_numpy(), then["high"].to_numpy()
    a = np.where(before["same"], np.searchsorted(low, before["low"], side="right") - 1, np.searchsorted(low, before["out_us"], side="right") - 1)
    b = np.where(before["same"], np.searchsorted(low, before["high"], side="left") - 1, a)
    many = b - a + 1
    x = before.iloc[np.repeat(np.arange(len(before)), many)].reset_index(drop=True)
    at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    y = then.iloc[at].reset_index(drop=True)
    wide = x["same"].to_numpy()
    out = x.copy()
    out["step"] = y["step"]
    out["low"] = np.where(wide, np.maximum(x["low"], low[at]), x["low"])
    out["high"] = np.where(wide, np.minimum(x["high"], high[at]), x["high"])
    kept = y["same"].to_numpy()
    out["out_us"], out["out_id"], out["same"] = np.where(kept, x["out_us"], y["out_us"]), np.where(kept, x["out_id"], y["out_id"]), wide & kept
    return out


def handed_on(steps: DataFrame, chains: list[tuple[int, int, int, int, int]]) -> dict[int, tuple[int, int]]:
    """The session open behind each partition of chains (part, chain, step, start_us, session_id); the session before step 0 is given.

    Doubling: in each round the functions of all partitions are composed with those that reach up to their beginning.
    """
    spark = steps.sparkSession
    places = spark.createDataFrame(chains, "of_part int, chain int, step int, known_us long, known_id long")
    first = F.col("step") == 0
    known = F.col("late") & first
    rows = steps.join(F.broadcast(places), F.col("part") == F.col("of_part")).where(~first | ((F.col("start_us") <= F.col("known_us")) & (F.col("known_us") < F.col("end_us"))))
    now = cut(rows.select(
        "chain", "step", F.when(first, F.lit(int(_FAR.min))).otherwise(F.col("start_us")).alias("low"), F.when(first, F.lit(int(_FAR.max))).otherwise(F.col("end_us")).alias("high"),
        F.when(known, F.col("known_us")).otherwise(F.col("value_cents")).alias("out_us"), F.when(known, F.col("known_id")).otherwise(F.col("session_id")).alias("out_id"), (F.col("late") & ~first).alias("same"),
    ))
    reach, longest = 1, 1 + max(x[2] for x in chains)
    while reach < longest:
        before = now.withColumn("step", F.col("step") + reach)
        last, now = now, cut(now.groupBy("chain", "step").cogroup(before.groupBy("chain", "step")).applyInPandas(_composed, now.schema))
        drop(last)
        reach *= 2
    of = {(x[1], x[2]): x[0] for x in chains}
    out = {of[r["chain"], r["step"]]: (r["out_us"], r["out_id"]) for r in now.collect()}  # one row a partition by now
    drop(now)
    return out


def entries_of(first: DataFrame, rules: Rules) -> dict:
    """For each partition [open session before it, what closes that at once, what closes the head, whether the head fills the partition].

    From a summary row of each partition in their order. An open session is (start_us, session_id), or for a while the
    number of the partition whose step function tells it.
    """
    told = sorted(first.where("kind = 'part'").collect(), key=lambda r: r["part"])
    fixed = lambda kind: {r["part"]: (r["start_us"], r["session_id"]) for r in first.where(F.col("kind") == kind).select("part", "start_us", "session_id").collect()}  # noqa: E731  one row a partition at most
    always, tails = fixed("open"), fixed("piece")
    entries, chains, client, last_us, final, left = {}, [], None, None, None, None
    for r in told:
        part, spans = r["part"], r["late"]
        opened = left if client == r["client_id"] else None
        broken = 0
        if opened is not None and r["start_us"] is not None:
            broken = 1 if final else 2 if r["start_us"] - last_us >= rules.gap else 0
        entries[part] = [opened, broken, r["n_late"], spans]
        if spans and r["start_us"] is None:  # late clicks only: what was open stays so
            client, left = r["client_id"], opened
            continue
        if not spans:
            left = tails.get(part)
        elif opened is None or broken:
            left = (r["value_cents"], r["n_clicks"])
        elif r["closed_by"] == "one":
            left = always[part]
        else:
            chains.append((part, chains[-1][1], chains[-1][2] + 1, 0, 0) if isinstance(opened, int) else (part, len(chains), 0, *opened))
            left = part
        client, last_us, final = r["session_id"], r["end_us"], r["final"]
    if chains:
        found = handed_on(first.where("kind = 'step'"), chains)
        for e in entries.values():
            e[0] = found[e[0]] if isinstance(e[0], int) else e[0]
    return entries


def sessions(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path_sha256) of every session."""
    spark = df.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    order = ["client_id", "ts_us", "late", "click_id"]
    dealt = timed(df, rules).repartitionByRange(n, *order).sortWithinPartitions(*order)
    first = cut(mapped(dealt, _first_pass(rules), _DDL))
    entries = entries_of(first, rules)
    heads = first.where("kind = 'head'").select("part", "client_id", "start_us", "late", "session_id", "value_cents", "final")
    heads = heads.repartition(n, "part").sortWithinPartitions("part", "client_id", "start_us", "late", "session_id")
    second = cut(mapped(heads, _second_pass(entries, rules), _DDL))
    both = first.where("kind IN ('session', 'piece')").unionAll(second)
    columns = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by"]
    pieces = both.where("kind = 'piece'").groupBy("client_id", "session_id", "start_us").agg(
        F.max("end_us").alias("end_us"), F.sum("n_clicks").alias("n_clicks"), F.sum("n_late").alias("n_late"), F.sum("value_cents").alias("value_cents"),
        F.coalesce(F.max("closed_by"), F.when(F.max(F.when(F.col("final").isNotNull(), F.struct("part", "final")))["final"], "end").otherwise("none")).alias("closed_by"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n_clicks") > 0, F.struct("part", "path")))), lambda x: x["path"]), ","), 256).alias("path_sha256"),
    )
    return both.where("kind = 'session'").select(*columns, F.col("path").alias("path_sha256")).unionAll(pieces.select(*columns, "path_sha256"))


def sessions_sql(rules: Rules = Rules()) -> str:
    """The same in SQL: islands by window functions, then a recursive step from each session's start to the next one."""
    return f"""
WITH RECURSIVE c AS (
  SELECT DISTINCT click_id, client_id, epoch_us(ts) AS t, coalesce(epoch_us(arrived_at) - epoch_us(ts) > {rules.late}, false) AS late,
    coalesce(kind = '{rules.final_kind}' AND value >= {rules.final_value}, false) AS final, CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER w AS rn, lag(final) OVER w AS final_before, lag(t) OVER w AS t_before FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY t, click_id)),
reasoned AS (SELECT *, CASE WHEN t_before IS NULL THEN 'first' WHEN final_before THEN 'end' WHEN t - t_before >= {rules.gap} THEN 'gap' END AS why FROM numbered),
islands AS (SELECT *, sum(CASE WHEN why IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY rn) AS island FROM reasoned),
starts(client_id, island, rn, t) AS (
  SELECT client_id, island, rn, t FROM islands WHERE why IS NOT NULL
  UNION ALL
  SELECT s.client_id, s.island, min(i.rn), min(i.t) FROM starts s JOIN islands i ON i.client_id = s.client_id AND i.island = s.island AND i.t > s.t + {rules.length} GROUP BY s.client_id, s.island),
bounds AS (SELECT client_id, rn, t, lead(rn) OVER w AS next_rn, lead(t) OVER w AS next_t FROM starts WINDOW w AS (PARTITION BY client_id ORDER BY rn)),
made AS (
  SELECT b.client_id, b.rn, b.t, b.next_rn, b.next_t, min_by(i.click_id, i.rn) AS session_id, max(i.t) AS end_us, count(*) AS n_clicks, CAST(sum(i.cents) AS BIGINT) AS value_cents, max_by(i.final, i.rn) AS final,
    sha256(string_agg(CAST(i.click_id AS VARCHAR), ',' ORDER BY i.rn)) AS path_sha256
  FROM bounds b JOIN islands i ON i.client_id = b.client_id AND i.rn >= b.rn AND (b.next_rn IS NULL OR i.rn < b.next_rn) GROUP BY ALL),
tardy AS (
  SELECT m.client_id, m.rn, count(*) AS n_late FROM made m JOIN c ON c.late AND c.client_id = m.client_id AND c.t >= m.t AND (m.next_t IS NULL OR c.t < m.next_t) GROUP BY ALL)
SELECT m.client_id, m.session_id, m.t AS start_us, m.end_us, m.n_clicks, coalesce(l.n_late, 0) AS n_late, m.value_cents,
  CASE WHEN m.next_rn IS NULL THEN CASE WHEN m.final THEN 'end' ELSE 'none' END ELSE coalesce(n.why, 'length') END AS closed_by, m.path_sha256
FROM made m LEFT JOIN tardy l ON l.client_id = m.client_id AND l.rn = m.rn LEFT JOIN islands n ON n.client_id = m.client_id AND n.rn = m.next_rn
"""
