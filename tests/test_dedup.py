import datetime
import json
import random

from hypothesis import given
from hypothesis import strategies as st

from strandline.operators import dedup

LOG = "line_id bigint, received_at timestamp_ntz, session_id string, type string, seq bigint, data string, ident string, number int"


def at(s):
    return None if s is None else datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def brute(rows):
    seen, out = set(), []
    for line, t, session, kind, seq, data in sorted(rows, key=lambda r: (r[1] is None, r[1] or at(0), r[0])):
        try:
            v = json.loads(data or "")
            v = json.loads(v) if isinstance(v, str) else v
        except ValueError:
            continue
        m = v.get("id") if kind == "user/message" else (v.get("message") or {}).get("id") if kind in dedup.MESSAGE_ID_AT else None
        m = (m or "").strip().lower()
        key = (session, m) if m else (session, kind, seq)
        if key in seen:
            out.append(line)
        seen.add(key)
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], LOG)


def test_surplus_equals_brute_force(spark):
    random.seed(11)
    rows = []
    for i in range(4000):
        kind = random.choice(["user/message", "assistant/message", "turn/start", "tool/call", None])
        ident = random.choice([None, "", " ", f"M{random.randint(0, 60)}", f" m{random.randint(0, 60)} "])
        body = {"id": ident} if kind == "user/message" else {"message": {"id": ident}} if random.random() < 0.8 else {"message": None}
        data = json.dumps(body)
        data = random.choice([data, data, json.dumps(data), data[:-2], None, "", "[]", "3"]) if random.random() < 0.3 and kind != "x" else data
        if data in ("[]", "3"):
            data = "{}"
        seq = random.choice([None, *range(0, 9000, 97)])
        rows.append((i, at(random.choice([None, *range(50)])), random.choice([None, "s1", "s2", "hot", "hot", "hot"]), kind, seq, data))
    got = sorted(r.line_id for r in dedup.surplus_rows(frame(spark, rows).repartition(7)).collect())
    assert got == brute(rows)
    kept = dedup.deduplicate(frame(spark, rows))
    assert kept.count() == len(rows) - len(got)


def test_hot_key_and_empty_log(spark):
    rows = [(i, at(i % 5), "s", "turn/start", 1, "{}") for i in range(30_000)]
    assert dedup.surplus_rows(frame(spark, rows).repartition(6)).count() == 29_999
    assert dedup.surplus_rows(frame(spark, rows[:1]).limit(0)).count() == 0


def test_ranges_merge_across_blocks(spark):
    numbers = [*range(0, 5000), *range(5001, 9000), 20_000]
    random.seed(1)
    random.shuffle(numbers)
    rows = [(i, at(i), "s", "turn/start", n, "{}") for i, n in enumerate(numbers + numbers[:50])]
    got = sorted((r.lo, r.hi, r.n) for r in dedup.seen_ranges(frame(spark, rows)).collect())
    assert got == [(0, 4999, 5000), (5001, 8999, 3999), (20_000, 20_000, 1)]


@given(st.lists(st.integers(-20, 20)))
def test_seen_ranges(numbers):
    seen, known = dedup.SeenRanges(), set()
    for n in numbers:
        assert seen.accept(n) == (n not in known)
        known.add(n)
    flat = [n for lo, hi in seen.ranges() for n in range(lo, hi + 1)]
    assert flat == sorted(known)
    assert all(b[0] > a[1] + 1 for a, b in zip(seen.ranges(), seen.ranges()[1:]))


@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 6))), st.lists(st.integers(-20, 20)))
def test_covered_ranges(spans, numbers):
    seen, known = dedup.SeenRanges(), set()
    for n in numbers[::2]:
        seen.accept(n)
        known.add(n)
    for lo, size in spans:
        seen.cover(lo, lo + size)
        known |= set(range(lo, lo + size + 1))
    for n in numbers:
        assert seen.accept(n) == (n not in known)
        known.add(n)
    assert [n for lo, hi in seen.ranges() for n in range(lo, hi + 1)] == sorted(known)
    assert all(b[0] > a[1] + 1 for a, b in zip(seen.ranges(), seen.ranges()[1:]))


def test_state_is_carried_between_deliveries(spark):
    random.seed(5)
    rows = []
    for i in range(900):
        kind = random.choice(["user/message", "turn/start", "tool/call"])
        data = json.dumps({"id": random.choice([None, f"m{random.randint(0, 40)}"])}) if random.random() < 0.9 else "{"
        rows.append((i, at(i), random.choice([None, "s1", "s2"]), kind, random.choice([None, *range(4000, 4200, 7)]), data))
    seen, got = None, []
    for part in (rows[:300], rows[300:310], rows[310:]):
        fresh, seen = dedup.accept_batch(frame(spark, part), seen)
        got += [r.line_id for r in fresh.collect()]
    surplus = set(brute(rows))
    parsed = [r[0] for r in rows if r[5] != "{"]
    assert sorted(got) == [i for i in parsed if i not in surplus]
    bounds = sorted((r.session_id or "", r.type, r.lo, r.hi) for r in dedup.merge_blocks(seen.where("lo is not null").select("session_id", dedup.F.col("scope").alias("type"), "lo", "hi")).collect())
    whole = sorted((r.session_id or "", r.type, r.lo, r.hi) for r in dedup.seen_ranges(frame(spark, rows)).collect())
    assert bounds == whole


def test_hot_producer_is_split_by_blocks(spark):
    n = 60_000
    rows = spark.range(2 * n).selectExpr("id as line_id", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id % 977) as received_at", "'s' as session_id", "'turn/start' as type", f"id % {n} as seq", "'{}' as data")
    keyed = dedup._in_arrival_order(dedup.keyed_rows(rows.repartition(8)), None)
    assert keyed.select("block").where("not early").distinct().count() == -(-n // dedup.RANGE_BLOCK)
    assert dedup.surplus_rows(rows).count() == n
    assert [(r.lo, r.hi) for r in dedup.seen_ranges(rows).collect()] == [(0, n - 1)]
