"""Sessions against a plain loop over each client's clicks, with borders of partitions everywhere."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest

from folioforge.llm import sessionise

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, part int, path string"
BEGIN = dt.datetime(2024, 1, 1)
COLUMNS = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def click(i, seconds, client, kind="view", value=1.0, late=0.0):
    ts = BEGIN + dt.timedelta(seconds=seconds)
    return (i, ts, ts + dt.timedelta(minutes=late), client, kind, value, "{}", 7, "x")


def plain(rows):
    """The contract, one client and one click after the other."""
    clients = {}
    for r in {r[0]: r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None}.values():
        clients.setdefault(r[3], []).append(r)
    out = []
    for client, own in clients.items():
        late = [r for r in own if r[2] is not None and us(r[2]) - us(r[1]) > 360 * 60_000_000]
        timely = sorted((r for r in own if r not in late), key=lambda r: (r[1], r[0]))
        made, last = [], None
        for r in timely:
            why = None
            if last is None:
                why = "first"
            elif last[4] == "error" and (last[5] or 0) >= 60:
                why = "end"
            elif us(r[1]) - us(last[1]) >= 10 * 60_000_000:
                why = "gap"
            elif us(r[1]) - us(made[-1][0][0][1]) > 40 * 60_000_000:
                why = "length"
            if why:
                if made:
                    made[-1][1] = why
                made.append([[], None])
            made[-1][0].append(r)
            last = r
        for i, (clicks, why) in enumerate(made):
            begin, until = clicks[0][1], made[i + 1][0][0][1] if i + 1 < len(made) else None
            final = clicks[-1][4] == "error" and (clicks[-1][5] or 0) >= 60
            cents = sum(int(np.floor(100 * (r[5] or 0) + 0.5)) for r in clicks)
            n_late = sum(begin <= r[1] and (until is None or r[1] < until) for r in late)
            path = hashlib.sha256(",".join(str(r[0]) for r in clicks).encode()).hexdigest()
            out.append((client, clicks[0][0], us(begin), us(clicks[-1][1]), len(clicks), n_late, cents, why or ("end" if final else "none"), path))
    return sorted(out)


def check(spark, rows, tasks, rules=sessionise.Rules()):
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = sorted(tuple(r) for r in sessionise.sessions(spark.createDataFrame(rows, SCHEMA), rules).select(*COLUMNS).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(rows)


def at_random(seed, n=700, clients=5, step=150, finals=0.05):
    draw = random.Random(seed)
    rows, clock = [], dict.fromkeys(range(clients), 0.0)
    for i in range(n):
        client = 0 if draw.random() < 0.5 else draw.randrange(clients)
        clock[client] += draw.choice([0, 0, draw.random() * step, draw.random() * step, 600, 599.999999, 2400.0 if draw.random() < 0.1 else 1])
        rows.append(click(i, clock[client], client, "error" if draw.random() < finals else "view", draw.choice([None, 60.0, 59.99, -3.335, 0.125, 120.0]), draw.choice([0, 0, 0, 1, 360, 361])))
    rows += draw.sample(rows, 60)  # repeated clicks
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "tasks"), [(1, 1), (2, 3), (3, 16), (4, 16)])
def test_sessions(spark, seed, tasks):
    check(spark, at_random(seed), tasks)


@pytest.mark.parametrize("every", [1.0, 37.0, 61.0])
def test_regular_clicks_of_one_client(spark, every):
    """An island that fills all partitions: what one hands to the next depends on what it gets, through the whole chain."""
    check(spark, [click(i, i * every, 1) for i in range(3000)] + [click(9000 + i, i * 70, 2) for i in range(40)], 13)


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_clicks_of_one_client(spark, seed):
    """As above with random steps, late clicks between and before, and a few breaks."""
    draw = random.Random(seed)
    rows, clock = [], 0.0
    for i in range(2500):
        clock += draw.choice([0.0, draw.random() * 90, draw.random() * 400])
        rows.append(click(i, clock, 1, "error" if i in (700, 701) else "view", 99.0, 400 if draw.random() < 0.2 else 0))
    rows += [click(9000 + i, clock + 10 + i, 1, late=400) for i in range(300)] + [click(9500 + i, i - 5, 1, late=400) for i in range(300)]
    check(spark, rows, 19)


def test_handing_over():
    """The step function of a run of clicks against a walk from each possible start."""
    draw = random.Random(5)
    for _ in range(40):
        ts = np.sort(np.array([draw.randrange(400) for _ in range(draw.randint(1, 60))]))
        low, high, last = sessionise.hand_over(ts, 50)
        assert low[0] == np.iinfo(np.int64).min and high[-1] == np.iinfo(np.int64).max and (low[1:] == high[:-1]).all()
        for start in range(int(ts[0]) - 60, int(ts[0]) + 1):
            opened, at = start, -1
            for i, t in enumerate(ts.tolist()):
                if t - opened > 50:
                    opened, at = t, i
            k = int(np.searchsorted(low, start, side="right")) - 1
            assert (last[k] == -1) == (at == -1) and (at == -1 or ts[last[k]] == opened)


def test_edges(spark):
    """Nulls in any column, ties, clicks exactly on every limit, clients with late clicks only, no rows."""
    rows = [
        click(1, 0, 1), click(2, 0, 1), click(3, 599.999999, 1), click(4, 1199.999999, 1), click(5, 2400 + 599, 1), click(6, 9000, 1, "error", 60.0), click(7, 9000, 1), click(8, 9000, 1, late=500),
        click(9, 5, 2, late=361), (10, None, BEGIN, 1, "view", 1.0, None, 1, None), (11, BEGIN, None, 3, None, None, None, None, None), (12, BEGIN, BEGIN, None, "error", 70.0, None, 1, None), (None, BEGIN, BEGIN, 1, "view", 1.0, None, 1, None),
        *[click(20 + i, i * 400, 4) for i in range(10)], click(40, 2400, 5), click(41, 0, 5), click(42, 2401, 5), click(43, 7, 5, late=360), click(44, -9, 5, late=361),
        *[click(50 + i, i * 480, 6) for i in range(11)],
    ]
    check(spark, rows, 4)
    check(spark, [], 4)
    assert sessionise.sessions(spark.createDataFrame([], SCHEMA)).columns == COLUMNS


def test_timestamps_with_a_zone(spark):
    rows = at_random(8, n=80)
    got = sessionise.sessions(spark.createDataFrame(rows, SCHEMA).selectExpr("click_id", "client_id", "kind", "value", "cast(ts as timestamp) AS ts", "cast(arrived_at as timestamp) AS arrived_at"))
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == plain(rows)
