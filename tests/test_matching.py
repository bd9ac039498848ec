"""Matching against brute force on small data, with partitions small enough to cross every boundary."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest

from cohortspark.operators import matching, nearest


def greedy(rows, caliper, h):
    """Closest remaining pair first; ties by place of the right row, then the nearest left one."""
    order = sorted(rows, key=lambda r: (r[2], h[r[0]], r[0]))
    place = {r[0]: i for i, r in enumerate(order)}
    pairs = []
    for a in rows:
        for b in rows:
            if a[1] == 1 and b[1] == 0 and abs(a[2] - b[2]) <= caliper:
                left, right = sorted((place[a[0]], place[b[0]]))
                pairs.append((abs(a[2] - b[2]), right, -left, a[0], b[0]))
    used, out = set(), set()
    for _, _, _, t, c in sorted(pairs):
        if t not in used and c not in used:
            used |= {t, c}
            out.add((t, c))
    return out


@pytest.mark.parametrize("kind,size", [("spread", 40), ("ties", 40), ("runs", 40), ("spread", 100000)])
def test_one_to_one_equals_brute_force(spark, kind, size):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        t = int(rng.random() < 0.6)
        if kind == "ties":
            s = float(rng.choice([0, 0, 0, 1, 2]))
        elif kind == "runs":
            s = t * 0.5 + rng.random() * 0.5
        else:
            s = rng.gauss(0.3 * t, 1)
        rows.append((i, t, s))
    df = spark.createDataFrame(rows, "id bigint, t int, s double")
    h = {r["id"]: r["h"] for r in df.selectExpr("id", "xxhash64(id) as h").collect()}
    got = [(r["treated_id"], r["control_id"]) for r in matching.match_one_to_one(df, "id", "t", "s", 0.3, size).collect()]
    assert len(got) == len(set(got))
    assert set(got) == greedy(rows, 0.3, h)


def test_nearest_controls_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.4), float(rng.randint(0, 4)), rng.gauss(0, 1), 1.0 * rng.randint(0, 1)) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, t int, a double, b double, c double")
    got = {(r["treated_id"], r["place"]): r["control_id"] for r in matching.nearest_controls(df, "id", "t", ["a", "b", "c"], 3, cell_rows=8).collect()}
    scaled = {r["id"]: r["x"] for r in matching.standardized(df, ["a", "b", "c"]).collect()}
    want = {}
    for i, t, *_ in rows:
        if t:
            near = sorted((sum((p - q) ** 2 for p, q in zip(scaled[i], scaled[j])) ** 0.5, j) for j, u, *_ in rows if not u)
            want.update({(i, k + 1): j for k, (_, j) in enumerate(near[:3])})
    assert got == want


@pytest.mark.parametrize("max_shift,local", [(1, 0), (1, 10 ** 6), (None, 10 ** 6)])
def test_risk_set_pairs_are_valid_and_complete(spark, max_shift, local):
    rng = random.Random(9)
    day = lambda n: f"2020-{1 + n // 28:02d}-{1 + n % 28:02d}"
    cases = [(i, day(rng.randint(0, 5)), day(rng.randint(20, 60))) for i in range(40)]
    pool = [(1000 + i, day(rng.randint(0, 5)), day(rng.randint(200, 300))) for i in range(60)]
    c = spark.createDataFrame(cases, "id bigint, s string, x string").selectExpr("id", "date(s) as s", "date(x) as x")
    p = spark.createDataFrame(pool, "id bigint, s string, e string").selectExpr("id", "date(s) as s", "date(e) as e")
    rows = matching.match_risk_set(c, p, "id", "s", "e", "x", horizon=182, max_shift=max_shift, local_rows=local).collect()
    assert sorted(r["case_id"] for r in rows) == list(range(40))
    got = [r for r in rows if r["control_id"] is not None]
    end = {r["id"]: r["e"] for r in p.collect()}
    assert len({r["control_id"] for r in got}) == len(got) > 10
    for r in got:
        assert (end[r["control_id"]] - r["index_date"]).days >= 182
        assert r["control_start"] <= r["index_date"] and (max_shift is None or abs((r["control_start"] - r["case_start"]).days) <= max_shift)
    # No case left over could still take a control left over within the shifts.
    used, done = {r["control_id"] for r in got}, {r["case_id"] for r in got}
    for a in c.collect():
        for b in p.collect():
            if a["id"] not in done and b["id"] not in used and b["s"] <= a["x"] and (max_shift is None or abs((a["s"] - b["s"]).days) <= max_shift):
                assert (b["e"] - a["x"]).days < 182
    # On the same start day as many pairs are made as any assignment can make.
    same = {}
    def take(a, seen):
        for b in p_rows:
            if b["id"] not in seen and b["s"] == a["s"] and (b["e"] - a["x"]).days >= 182:
                seen.add(b["id"])
                if b["id"] not in same or take(same[b["id"]], seen):
                    same[b["id"]] = a
                    return True
        return False
    p_rows = p.collect()
    assert sum(take(a, set()) for a in c.collect()) == sum(r["control_start"] == r["case_start"] for r in got)


def test_risk_set_keeps_late_ends_for_late_cases(spark):
    c = spark.sql("SELECT * FROM VALUES (1L, date'2020-01-01', date'2020-01-10'), (2L, date'2020-01-01', date'2020-02-10'), (3L, date'2020-01-01', null) AS t(id, s, x)")
    p = spark.sql("SELECT * FROM VALUES (7L, date'2020-01-01', date'2020-08-20'), (8L, date'2020-01-01', date'2020-07-20') AS t(id, s, e)")
    got = matching.match_risk_set(c, p, "id", "s", "e", "x").collect()
    assert sorted((r["case_id"], r["control_id"] or 0) for r in got) == [(1, 8), (2, 7), (3, 0)]
    assert matching.match_risk_set(c.limit(0), p, "id", "s", "e", "x").count() == 0
    assert [r["control_id"] for r in matching.match_risk_set(c, p.limit(0), "id", "s", "e", "x").collect()] == [None] * 3


def risk_sets(copies):
    """Per copy, on a day of its own: five cases of three thresholds, the strictest open to two controls, and eight controls."""
    day = lambda n: (date(1950, 1, 1) + timedelta(days=n)).isoformat()
    cases, pool = [], []
    for k in range(copies):
        at = 3 * k
        cases += [(100 * k + i, day(at), day(at + x)) for i, x in enumerate((50, 30, 30, 10, 10))]
        pool += [(100 * k + 50 + i, day(at), day(at + 182 + e)) for i, e in enumerate((60, 55, 40, 40, 35, 20, 20, 9))]
    return cases, pool


def drawn_one_by_one(cases, pool):
    """Per day the strictest case first: each takes a place among the open controls that are left, then the first place is filled up."""
    out = {}
    for start in {c[1] for c in cases}:
        mine = sorted((c for c in cases if c[1] == start), key=lambda c: (c[2], hashlib.md5(str(c[0]).encode()).hexdigest()), reverse=True)
        left = [p[0] for p in sorted((p for p in pool if p[1] == start), key=lambda p: (-date.fromisoformat(p[2]).toordinal(), hashlib.md5(str(p[0]).encode()).hexdigest()))]
        ends = {p[0]: date.fromisoformat(p[2]) for p in pool}
        for q, (name, _, index) in enumerate(mine):
            room = sum(ends[x] >= date.fromisoformat(index) + timedelta(days=182) for x in ends if x // 100 == name // 100)
            at = q + int(int(hashlib.md5(f"0:{name}".encode()).hexdigest()[:13], 16) / 16 ** 13 * (room - q))
            out[name] = left[at]
            left[at] = left[q]
    return out


def test_risk_set_draws_at_random(spark):
    copies = 400
    cases, pool = risk_sets(copies)
    c = spark.createDataFrame(cases, "id bigint, s string, x string").selectExpr("id", "date(s) as s", "date(x) as x")
    p = spark.createDataFrame(pool, "id bigint, s string, e string").selectExpr("id", "date(s) as s", "date(e) as e")
    got, local = ({r["case_id"]: r["control_id"] for r in matching.match_risk_set(c, p, "id", "s", "e", "x", max_shift=0, local_rows=n).collect()} for n in (0, 10 ** 6))
    assert got == local == drawn_one_by_one(cases, pool)
    # The strictest case takes either of its two controls; of the last case's, each one open to it is as likely as drawing one by one makes it.
    shares = Counter((case % 100, control % 100 - 50) for case, control in got.items())
    chance = defaultdict(float)

    def walk(q, left, rooms, p):
        if q < len(rooms):
            free = [x for x in range(rooms[q][1]) if x not in left]
            for x in free:
                chance[rooms[q][0], x] += p / len(free)
                walk(q + 1, left | {x}, rooms, p / len(free))

    # Equal thresholds stand in the order of a hash, so their cases are counted together.
    walk(0, frozenset(), [("a", 2), ("b", 5), ("b", 5), ("c", 7), ("c", 7)], 1.0)
    groups = {"a": (0,), "b": (1, 2), "c": (3, 4)}
    for (g, control), p in chance.items():
        seen = sum(shares[i, control] for i in groups[g])
        assert abs(seen - copies * p) <= 5 * (copies * p) ** 0.5, (g, control)
    assert sum(shares.values()) == 5 * copies and len(set(got.values())) == 5 * copies


def test_nearest_rows_over_deep_trees(spark):
    rng = random.Random(8)
    points = [(i, [rng.gauss(0, 1), rng.choice([0.0, 1.0]), rng.expovariate(1), float(rng.randint(0, 2))]) for i in range(4000)]
    points += [(5000 + i, [9.0, 0.0, 1e3, 0.0]) for i in range(40)]
    queries = [(i, [rng.gauss(0, 1), rng.choice([0.0, 1.0]), rng.expovariate(1), rng.choice([0.0, 5.0])]) for i in range(60)]
    q, p = spark.createDataFrame(queries, "id bigint, x array<double>"), spark.createDataFrame(points, "hit_id bigint, x array<double>")
    got, compared = {}, {}
    for r in nearest.search(q, p, 4, 3, cell_rows=8).collect():
        got[r["id"], r["place"]], compared[r["id"]] = (r["hit_id"], r["distance"]), r["compared"]
    for i, x in queries:
        want = sorted((math.dist(x, y), j) for j, y in points)[:3]
        assert [(got[i, k + 1][0], pytest.approx(got[i, k + 1][1])) for k in range(3)] == [(j, d) for d, j in want]
    assert sum(compared.values()) < len(queries) * len(points) / 20
    # Four times the points: clearly fewer than four times the comparisons.
    quarter = p.where("hit_id % 4 = 0")
    few = sum(r["compared"] for r in nearest.search(q, quarter, 4, 3, cell_rows=8).where("place = 1").collect())
    assert sum(compared.values()) < 3 * few
    assert nearest.search(q, p.limit(0), 4, 3).collect() == []
    assert sorted(r["place"] for r in nearest.search(q.limit(1), p.limit(2), 4, 3).collect()) == [1, 2]


def test_risk_sets_are_the_same_in_one_task(spark):
    rng = random.Random(2)
    day = lambda n: (date(2020, 1, 1) + timedelta(days=n)).isoformat()
    cases = [(i, day(s := rng.randint(0, 3)), day(s + rng.randint(0, 40))) for i in range(90)]
    pool = [(500 + i, day(rng.randint(0, 6)), day(rng.choice([150, 190, 200, 215, 230, 300]))) for i in range(70)]
    c = spark.createDataFrame(cases, "id bigint, s string, x string").selectExpr("id", "date(s) as s", "date(x) as x")
    p = spark.createDataFrame(pool, "id bigint, s string, e string").selectExpr("id", "date(s) as s", "date(e) as e")
    first, second = (sorted(tuple(r) for r in matching.match_risk_set(c, p, "id", "s", "e", "x", max_shift=3, local_rows=n).fillna(-1, ["control_id"]).drop("control_start").collect()) for n in (0, 10 ** 6))
    assert first == second and sum(r[1] > 0 for r in first) > 30


def test_nearest_rows_store_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vector = lambda: [rng.random() for _ in range(4)]
    q = spark.createDataFrame([(i, vector()) for i in range(500)], "id bigint, x array<double>")
    p = spark.createDataFrame([(i, vector()) for i in range(6000)], "hit_id bigint, x array<double>")
    kept, keep = [], nearest.durable

    def counted(df):
        kept.append((out := keep(df)).count())
        return out

    monkeypatch.setattr(nearest, "durable", counted)
    assert nearest.search(q, p, 4, 2, cell_rows=256).count() == 1000
    # No level keeps a query for most of its cells.
    assert max(kept) <= 50 * 500


def test_nearest_rows_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = random.Random(6)
    points = [(i, [float(rng.randint(0, 3)), 0.0]) for i in range(90)] + [(200 + i, [9.0, 9.0]) for i in range(60)]
    queries = [(i, [float(rng.randint(0, 9)), 0.5]) for i in range(80)]
    q, p = spark.createDataFrame(queries, "id bigint, x array<double>"), spark.createDataFrame(points, "hit_id bigint, x array<double>")
    got = {(r["id"], r["place"]): (r["hit_id"], r["distance"]) for r in nearest.search(q, p, 2, 70, cell_rows=8).collect()}
    for i, x in queries:
        want = sorted((math.dist(x, y), j) for j, y in points)[:70]
        assert [got[i, k + 1] for k in range(70)] == [(j, pytest.approx(d)) for d, j in want]


def test_risk_sets_of_few_cases_and_many_controls_take_one_task(spark, monkeypatch):
    rng = random.Random(3)
    day = lambda n: (date(2020, 1, 1) + timedelta(days=n)).isoformat()
    cases = [(i, day(s := rng.randint(0, 4)), day(s + rng.randint(0, 40))) for i in range(60)]
    pool = [(500 + i, day(rng.randint(0, 6)), day(rng.choice([150, 190, 200, 215, 230, 300]))) for i in range(150)]
    c = spark.createDataFrame(cases, "id bigint, s string, x string").selectExpr("id", "date(s) as s", "date(x) as x")
    p = spark.createDataFrame(pool, "id bigint, s string, e string").selectExpr("id", "date(s) as s", "date(e) as e")
    made = lambda n: sorted((r["case_id"], r["control_id"] or 0) for r in matching.match_risk_set(c, p, "id", "s", "e", "x", max_shift=1, local_rows=n).collect())
    want, rounds, plain = made(0), [], matching._ends_above
    monkeypatch.setattr(matching, "_ends_above", lambda a, b: rounds.append(1) or plain(a, b))
    assert made(60) == want and not rounds


def test_risk_set_copies_of_a_control_leave_together(spark):
    c = spark.sql("SELECT * FROM VALUES (1L, date'2020-01-01', date'2020-01-10'), (2L, date'2020-01-02', date'2020-01-10') AS t(id, s, x)")
    p = spark.sql("SELECT * FROM VALUES (7L, date'2020-01-01', date'2020-08-20'), (7L, date'2020-01-01', date'2020-08-20') AS t(id, s, e)")
    got = matching.match_risk_set(c, p, "id", "s", "e", "x").collect()
    assert sorted((r["case_id"], r["control_id"] or 0) for r in got) == [(1, 7), (2, 0)]


def paired_shift_by_shift(cases, pool, horizon=182):
    """The rule tried out: per shift and start day the most cases of the smallest thresholds, then draws one by one; copies of a control leave together."""
    mark = lambda x: (hashlib.md5(str(x).encode()).hexdigest(), x)
    chance = lambda x: int(hashlib.md5(f"0:{x}".encode()).hexdigest()[:13], 16) / 16 ** 13
    cases, pool, out = list(cases), list(pool), {}
    for shift in sorted(range(-400, 401), key=lambda s: (abs(s), s)):
        for start in sorted({c[1] for c in cases}):
            day = start + shift
            asked = sorted((x + horizon, mark(i)) for i, s, x in cases if s == start and day <= x)
            left = sorted((-e, mark(i)) for i, s, e in pool if s == day)
            reach = [sum(-e >= t for e, _ in left) for t, _ in asked]
            k = min([len(asked), *(sum(u < t for u, _ in asked) + r for (t, _), r in zip(asked, reach))])
            for q in range(k):
                case = asked[k - 1 - q][1][1]
                at = q + int(chance(case) * (reach[k - 1 - q] - q))
                out[case] = left[at][1][1]
                left[at] = left[q]
            cases, pool = [c for c in cases if c[0] not in out], [p for p in pool if not (p[1] == day and p[0] in out.values())]
    return out


@pytest.mark.parametrize("copies", [0, 15])
def test_risk_sets_of_many_shifts_take_few_tasks(spark, monkeypatch, copies):
    rng = random.Random(11)
    cases = [(i, s := rng.randint(0, 9), s + rng.randint(0, 110)) for i in range(240)] + [(240 + i, i, 400) for i in range(5)]
    pool = [(1000 + i, s := rng.randint(0, 120), s + rng.randint(150, 230)) for i in range(1200)]
    pool += [p for p in pool if p[1] < 12 and p[2] - p[1] > 200][:copies]
    day = "date_add(date'2020-01-01', {0}) as {0}".format
    c = spark.createDataFrame(cases, "id bigint, s int, x int").selectExpr("id", day("s"), day("x"))
    p = spark.createDataFrame(pool, "id bigint, s int, e int").selectExpr("id", day("s"), day("e"))
    rounds, tasks, plain, alone = [], [], matching._ends_above, matching._settled_in_one_task

    def told(cases, *more):
        tasks.append(cases.count())
        return alone(cases, *more)

    monkeypatch.setattr(matching, "_ends_above", lambda a, b: rounds.append(1) or plain(a, b))
    monkeypatch.setattr(matching, "_settled_in_one_task", told)
    want = paired_shift_by_shift(cases, pool)
    found = matching.match_risk_set(c, p, "id", "s", "e", "x", local_rows=90).collect()
    assert {r["case_id"]: r["control_id"] for r in found if r["control_id"]} == want and len(want) == 240 < len(found) == 245
    # A shift with many cases is a round of its own; the many shifts with few cases share tasks, each within its bound.
    assert len(rounds) <= 1 and max(tasks) <= 90 - 2 * copies and 2 <= len(tasks) <= 8
