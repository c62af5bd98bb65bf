"""Scenarios whose results are exact by design, and models of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from seriescope.functions import exposition
from seriescope.operators import analytics, estimate, limit, sketches, windows
from seriescope.operators.series import fingerprint, flat, prune
from seriescope.plans.spec import StreamSpec, format_duration, load, parse_duration, projected
from seriescope.sources import wire
from seriescope.streaming import runner

SCHEMA = "labels array<struct<name:string,value:string>>, ts timestamp_ntz, arrival long"
MINUTE = 60_000_000


def at(spark, rows):
    """rows: (labels as dict or pairs, minute)."""
    from datetime import datetime, timedelta

    pairs = lambda x: list(x.items()) if isinstance(x, dict) else x
    return spark.createDataFrame([(pairs(x), datetime(2024, 1, 1) + timedelta(minutes=m), i) for i, (x, m) in enumerate(rows)], SCHEMA)


def cross(f, b, z, seed="", minute=0):
    """Series over foo x bar x baz; a size of 0 leaves the label out."""
    out = []
    for i in range(max(1, f)):
        for j in range(max(1, b)):
            for k in range(max(1, z)):
                labels = {"__name__": "metric"} | ({"foo": f"{seed}{i}"} if f else {}) | ({"bar": f"{seed}{j}"} if b else {}) | ({"baz": f"{seed}{k}"} if z else {})
                out.append((labels, minute))
    return out


def counts(df):
    return {tuple(r.key): r.value for r in df.collect()}


def test_spec_and_config():
    specs = load("streams:\n- interval: 15m\n  group_by: [job, __name__]\n  hll_precision: 0\n- interval: 30m\n")
    assert specs[0].group_by == ("__name__", "job") and specs[0].interval_text == "15m0s" and specs[0].hll_precision == 14 and specs[1].keys_text == "__global__"
    assert projected(specs) == ["__name__", "job"]
    assert [format_duration(parse_duration(x)) for x in ("90s", "1h", "1h30m", "1.5s", "5m")] == ["1m30s", "1h0m0s", "1h30m0s", "1.5s", "5m0s"]
    for bad in ("streams: [{interval: 5m, what: 1}]", "stream: []", "streams: [{hll_precision: 3}]", "streams: [{interval: 5x}]", "streams: [{group_by: ['a-b']}]", ""):
        with pytest.raises(ValueError):
            load(bad)
    assert load("", ("node",)) == []


@pytest.mark.parametrize("n", [0, 1, 10, 100, 1000])
def test_global_counts(spark, n):
    rows = [([("id", str(i))], 0) for i in range(n)] * 2
    assert estimate.cardinality(at(spark, rows)).first().value == n
    assert estimate.cardinality(at(spark, rows), exact=False).first().value == n


def test_identity(spark):
    df = at(spark, [([("a", "1"), ("b", "2")], 0), ([("b", "2"), ("a", "1")], 0), ([], 0), ([("a", ""), ("a", "x")], 0)])
    assert df.select(fingerprint(F.col("labels"))).distinct().count() == 4
    assert df.select(fingerprint(F.col("labels"), sort_labels=True)).distinct().count() == 3
    assert estimate.cardinality(df, exact=False).first().value == 4
    assert counts(estimate.cardinality(df, ("a",))) == {("1",): 2, ("",): 1}  # the first of equal names counts
    assert df.select(prune(F.col("labels"), ["b"]).alias("l")).where("size(l) = 1").count() == 2


@pytest.mark.parametrize("f,b,z,keys,groups,each", [(10, 10, 10, ("__name__",), 1, 1000), (0, 10, 10, ("foo",), 0, 0), (0, 0, 10, ("foo", "bar"), 0, 0), (1, 100, 0, ("foo",), 1, 100), (1, 10, 10, ("foo",), 1, 100), (2, 2, 50, ("bar", "foo"), 4, 50)])
def test_grouped_counts(spark, f, b, z, keys, groups, each):
    df = at(spark, cross(f, b, z))
    for exact in (True, False):
        got = counts(estimate.cardinality(df, keys, exact))
        assert len(got) == groups and set(got.values()) <= {each}
    assert estimate.group_count(df, keys).first().value == groups


@pytest.mark.parametrize("seed2,minute2,want", [("", 0, {100}), ("", 6, {100}), ("two", 6, {100}), (None, 0, {100})])
def test_rotation(spark, seed2, minute2, want):
    """Interval 10m: a rotation every 5 minutes."""
    spec = StreamSpec(interval="10m", group_by=("foo",))
    rows = cross(1, 10, 10, "one") + (cross(1, 10, 10, "one" if seed2 == "" else seed2, minute2) if seed2 is not None else [])
    now = windows.as_of(at(spark, rows), spec, 1_704_067_200_000_000 + 8 * MINUTE)
    got = counts(now)
    assert set(got.values()) == want and len(got) == (2 if seed2 == "two" else 1)
    assert counts(windows.as_of(at(spark, cross(1, 10, 10)), spec, 1_704_067_200_000_000 + 11 * MINUTE)) == {}


def test_reset_and_windows(spark):
    spec = StreamSpec(interval="10m", group_by=("foo",))
    df = at(spark, [({"foo": "a", "x": "1"}, 1), ({"foo": "a", "x": "2"}, 6), ({"foo": "b"}, 6)])
    assert counts(windows.as_of(df, spec, 1_704_067_200_000_000 + 7 * MINUTE)) == {("a",): 2, ("b",): 1}
    assert counts(windows.as_of(df, spec, 1_704_067_200_000_000 + 7 * MINUTE, reset_us=1_704_067_200_000_000 + 2 * MINUTE)) == {("a",): 1, ("b",): 1}
    got = {(r.key[0], r.window_end.minute): r.value for r in windows.windowed(df, spec).collect()}
    assert got == {("a", 5): 1, ("a", 10): 2, ("a", 15): 1, ("b", 10): 1, ("b", 15): 1}


@pytest.mark.parametrize("most,visible,rejected", [(3, "abc", 0), (2, "ab", 1), (1, "a", 2)])
def test_limit_once(spark, most, visible, rejected):
    df = at(spark, [({"foo": x}, 0) for x in "abcab"])
    assert {k[0] for k in counts(limit.limited(df, ("foo",), most))} == set(visible)
    row = limit.summary(df, ("foo",), most).first()
    assert (row.live, row.rejected, row.group_count) == (len(visible), rejected, 3)


@pytest.mark.parametrize("most,visible,rejected", [(2, "ab", 1), (3, "abc", 0)])
def test_limit_carried_over(spark, most, visible, rejected):
    spec = StreamSpec(interval="10m", group_by=("foo",), group_limit=most)
    df = at(spark, [({"foo": "a"}, 0), ({"foo": "b"}, 1), ({"foo": "a"}, 6), ({"foo": "c"}, 7)])
    last = {r.gen: r for r in limit.limit_history(df, spec).collect()}
    gen = sorted(last)[1]
    assert (last[gen].live, last[gen].rejected, last[gen].group_count) == (len(visible), rejected, 3)
    assert {r.key[0] for r in limit.limited_windows(df, spec).where(F.col("gen") == gen).collect()} == set(visible)


def test_limit_many(spark):
    df = at(spark, [({"foo": f"a{i}"}, 0) for i in range(103)])
    row = limit.summary(df, ("foo",), 3).first()
    assert (row.live, row.rejected, row.group_count) == (3, 100, 103)


def model(trace, most):
    """The rule as it runs: live groups, a drop for whoever finds no slot, and a rotation that forgets."""
    out, cur, prev, shown = {}, {}, {}, {}
    for gen in range(5):
        rejected = set()
        for key, value in trace.get(gen, []):
            if key in cur or key in prev or len(cur.keys() | prev.keys()) < most:
                if key not in rejected or key in cur or key in prev:
                    cur.setdefault(key, set()).add(value)
            else:
                rejected.add(key)
        shown = {k: len(cur.get(k, set()) | prev.get(k, set())) for k in cur.keys() | prev.keys()}
        out[gen] = (shown, len(cur.keys() | prev.keys()), len(rejected))
        prev, cur = cur, {}
    return out


def test_limit_against_a_model(spark):
    rng = random.Random(5)
    for _ in range(4):
        most, rows, trace = rng.randrange(1, 5), [], {}
        for gen in range(5):
            for _ in range(rng.randrange(1, 14)):
                key, value = rng.choice("abcdefg"), str(rng.randrange(3))
                rows.append(({"foo": key, "v": value}, gen * 5))
                trace.setdefault(gen, []).append((key, value))
        spec = StreamSpec(interval="10m", group_by=("foo",), group_limit=most)
        df = at(spark, rows)
        first = 1_704_067_200_000_000 // spec.half_us
        got = {}
        for r in limit.limited_windows(df, spec).collect():
            got.setdefault(r.gen - first, {})[r.key[0]] = r.value
        history = {r.gen - first: r for r in limit.limit_history(df, spec).collect()}
        for gen, (shown, live, rejected) in model(trace, most).items():
            assert got.get(gen, {}) == shown and (history[gen].live, history[gen].rejected) == (live, rejected)


def test_admissions_read_early_keys_only(spark):
    """Against one pass over all groups, on traces with many more groups than slots."""
    rng, rows = random.Random(11), []
    for gen in (0, 1, 2, 4, 5):
        keys = rng.sample(range(60), 40)
        rows += [(gen, [f"k{k}"], gen * 100 + i // 2) for i, k in enumerate(keys)]
    groups = spark.createDataFrame(rows, "gen long, key array<string>, first_seen long")
    for most in (1, 3, 17, 100):
        want, before, last = set(), set(), None
        for gen in (0, 1, 2, 4, 5):
            before = before if last == gen - 1 else set()
            free, now, last = most - len(before), set(), gen
            for _, key, seen in sorted((r for r in rows if r[0] == gen), key=lambda r: (r[2], r[1])):
                ok = key[0] in before or free > 0
                free -= key[0] not in before and ok
                now |= {key[0]} if ok else set()
                want.add((gen, key[0], seen, ok))
            before = now
        got = [(r.gen, r.key[0], r.first_seen, r.admitted) for r in limit.admissions(groups, most).collect()]
        assert len(got) == len(rows) and set(got) == want
        assert limit.earliest(groups.withColumn("stream", F.lit(0)), most).count() <= 5 * most


def test_streams_share_a_scan(spark):
    df = at(spark, cross(2, 3, 4))
    specs = [StreamSpec(), StreamSpec(group_by=("foo",)), StreamSpec(group_by=("bar", "foo")), StreamSpec(group_by=("nope",))]
    got = {}
    for r in estimate.multi_stream(df, specs).collect():
        got.setdefault(r.stream, {})[tuple(r.key)] = r.value
    assert got == {i: counts(estimate.cardinality(df, s.group_by)) for i, s in enumerate(specs[:3])}
    plan = estimate.multi_stream(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.array(F.struct(F.lit("foo").alias("name"), F.col("event_type").alias("value"))).alias("labels")), specs)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_sketches_merge(spark, tmp_path):
    df = at(spark, cross(3, 10, 20))
    spec = StreamSpec(interval="10m", group_by=("foo",), labels={"dc": "x"})
    for node in range(3):
        sketches.write(sketches.sketch(df.where(F.pmod("arrival", F.lit(3)).isin(node, (node + 1) % 3)), spec, f"n{node}"), str(tmp_path / f"n{node}"))
    found, lost = sketches.read(spark, [str(tmp_path / f"n{n}") for n in range(4)])
    assert lost == [str(tmp_path / "n3")]
    assert counts(sketches.merged(found).select("key", "value")) == counts(estimate.cardinality(df, ("foo",), exact=False))
    rejected = found.where("node = 'n0'").select("interval", "group_by_keys", F.array(F.lit("other")).alias("key"))
    assert sketches.merged_summary(found, rejected.unionAll(rejected)).first().value == 4
    other = sketches.sketch(df, StreamSpec(interval="10m", group_by=("foo",), labels={"dc": "x"}, hll_precision=10))
    with pytest.raises(Exception, match="HLL_UNION_DIFFERENT_LG_K"):
        sketches.merged(found.unionAll(other)).collect()


def test_lines(spark):
    special = {'a"b': r"a\"b", "a\\b": r"a\\b", "a\nb": r"a\nb", "a\tb": r"a\tb", "a\rb\a\b\f\v": r"a\rb\a\b\f\v", "\x00\x1b\x7f é漢": r"\x00\x1b\x7f é漢", "\u00a0\u200b\u2028": r"\u00a0\u200b\u2028", "\U000e0001\U0001f600": "\\U000e0001\U0001f600"}
    spec = StreamSpec(interval="10m", group_by=("foo",), group_limit=5, labels={"z": "1", "a": "2"})
    got = {r.line for r in exposition.lines(estimate.cardinality(at(spark, [({"foo": x}, 0) for x in special]), ("foo",)), spec).collect()}
    head = 'cardinality_estimate{interval="10m0s",a="2",z="1",group_by_keys='
    want = {f'{head}"foo",group_by_values="{x}",by_foo="{x}"}} 1' for x in special.values()}
    assert got == want | {f'{head}"__group__",group_by_values="foo"}} 8', 'cardinality_group_limit{interval="10m0s",group_by_keys="__group__",group_by_values="foo"} 5'}
    assert [exposition._quote(x) for x in special] == [f'"{x}"' for x in special.values()]
    assert exposition.lines(estimate.cardinality(at(spark, [({}, 0)])), StreamSpec(interval="1h")).first().line == 'cardinality_estimate{interval="1h0m0s",group_by_keys="__global__"} 1'


def test_the_name_of_the_metric_as_a_key(spark):
    spec = StreamSpec(interval="10m", group_by=("__name__",), group_limit=12345)
    got = {r.line for r in exposition.lines(estimate.cardinality(at(spark, [(x | {"__name__": "the_metric_name"}, m) for x, m in cross(10, 10, 10)]), ("__name__",), exact=False), spec).collect()}
    assert got == {
        'cardinality_estimate{interval="10m0s",group_by_keys="__name__",group_by_values="the_metric_name",by__name__="the_metric_name"} 1000',
        'cardinality_estimate{interval="10m0s",group_by_keys="__group__",group_by_values="__name__"} 1',
        'cardinality_group_limit{interval="10m0s",group_by_keys="__group__",group_by_values="__name__"} 12345',
    }


def test_wire(spark):
    series = [[("__name__", f"m{i}"), ("job", "é" * (i % 5)), ("empty", "")] for i in range(2500)]
    bodies = [(0, wire.encode(series)), (1, wire.encode(series, "zstd")), (2, b"\xff\xff"), (3, wire.encode(series)[:-10]), (4, None), (5, wire.encode([]))]
    requests = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in bodies], "request long, body binary")
    rows = wire.read_requests(requests).collect()
    for i in (0, 1):
        assert [[(x.name, x.value) for x in r.labels] for r in rows if r.request == i] == series
    assert {r.request for r in rows if r.error} == {2, 3, 4} and not [r for r in rows if r.request == 5]
    small = wire.read_requests(requests.where("request < 2"), most=1000, wanted=frozenset(["job"])).collect()
    assert len(small) == 2 and all("1000" in r.error for r in small)
    assert {x.name for r in wire.read_requests(requests.where("request = 0"), wanted=frozenset(["job"])).collect() for x in r.labels} == {"job"}


def test_wire_at_once_equals_field_by_field(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab漢é\0") for _ in range(rng.choice([0, 1, 5, 60, 200, 1500])))
    for k in range(60):
        series = [[(word() or "n", word() or "v") for _ in range(rng.randrange(6))] for _ in range(rng.randrange(30))]
        message = b"".join(wire._field(1, b"".join(wire._field(1, wire._field(1, n.encode()) + wire._field(2, v.encode())) for n, v in x) + (wire._field(2, b"\x10\x01") if rng.random() < 0.8 else b"")) for x in series)
        names, values, counts, known = wire.decode_at_once(message)
        assert known == [wire._identity(b"".join(wire._field(1, wire._field(1, n.encode()) + wire._field(2, v.encode())) for n, v in x)) for x in series]
        assert [list(zip(names[b - c : b].to_pylist(), values[b - c : b].to_pylist())) for b, c in zip(counts.cumsum().tolist(), counts.tolist())] == series
        labels = wire.Labels()
        for cut in (message[: rng.randrange(len(message) + 1)], message + bytes([rng.randrange(256) for _ in range(9)])):
            quick = wire.decode_at_once(cut)
            try:
                slow = [[(labels.names[i], labels.values[i]) for i in x] for x in wire.decode(cut, labels)]
            except ValueError:
                slow = None
            if quick is not None:
                assert slow == [list(zip(quick[0][b - c : b].to_pylist(), quick[1][b - c : b].to_pylist())) for b, c in zip(quick[2].cumsum().tolist(), quick[2].tolist())]
    broken = wire._field(1, wire._field(1, wire._field(1, b"n\xff") + wire._field(2, b"v")))
    assert wire.decode_at_once(broken) is None and wire.decode_at_once(b"") is not None
    swapped = wire._field(1, wire._field(1, wire._field(2, b"v") + wire._field(1, b"n")) + wire._field(3, b"ab"))
    assert wire.decode_at_once(swapped) is None
    body = wire.pa.compress(broken + swapped, codec="snappy", asbytes=True)
    rows = wire.read_requests(spark.createDataFrame([("id", bytearray(body))], "request string, body binary")).collect()
    assert [[tuple(x) for x in r.labels] for r in rows] == [[("n\ufffd", "v")], [("n", "v")]] and {r.request for r in rows} == {"id"}
    assert rows[1].fp == wire._identity(wire._field(1, wire._field(1, b"n") + wire._field(2, b"v")))


def test_limits_hold_for_each_stream(spark):
    """Estimates of several streams under limits of their own, against the rule as it runs."""
    rng = random.Random(21)
    rows, trace = [], {}
    for gen in range(5):
        for _ in range(rng.randrange(4, 14)):
            key, value = rng.choice("abcdefg"), str(rng.randrange(3))
            rows.append(({"foo": key, "v": value}, gen * 5))
            trace.setdefault(gen, []).append((key, value))
    df = at(spark, rows)
    specs = [StreamSpec(interval="10m", group_by=("foo",), group_limit=n) for n in (2, 4, 100)] + [StreamSpec(interval="10m")]
    from datetime import datetime, timedelta

    for i, most in enumerate((2, 4, 100)):
        for exact in (True, False):
            got = {}
            for r in windows.estimates(df, [specs[i], specs[3]], exact).collect():
                got.setdefault((r.as_of - datetime(2024, 1, 1)) // timedelta(minutes=5) - 1, {})[r.group_by_keys, r.group_by_values] = r.value
            for gen, (shown, live, dropped) in model(trace, most).items():
                assert {k[1]: v for k, v in got[gen].items() if k[0] == "foo"} == shown
                assert got[gen]["__group__", "foo"] == live + dropped
    firsts = list(dict.fromkeys(k for x in trace.values() for k, _ in x))
    both = estimate.multi_stream(df, specs).collect()
    for i, most in enumerate((2, 4, 100)):
        assert {r.key[0] for r in both if r.stream == i} == set(firsts[:most])
    assert limit.reach_limit(df.select(F.lit(2).alias("stream"), F.array(F.col("labels")[0]["value"]).alias("key"), F.lit(0).alias("gen")), specs) == []


def test_a_long_history_runs_in_chains(spark):
    """10,000 generations, of which a few are full: those are judged in chains, apart from each other."""
    n = 10_000
    groups = spark.range(n * 4).select((F.col("id") / 4).cast("long").alias("gen"), F.array(F.concat(F.lit("k"), F.when(F.col("id") / 4 % 500 < 3, F.col("id") % 97).otherwise(F.col("id") % 2).cast("string"))).alias("key"), F.col("id").alias("first_seen")).groupBy("gen", "key").agg(F.min("first_seen").alias("first_seen"))
    told = limit.chains(groups.select(F.lit(0).alias("stream"), "gen", "key"), 3)
    full = told.where("full").groupBy("chain").agg(F.count("*").alias("n")).collect()
    assert len(full) == 20 and max(r.n for r in full) <= 6
    before, want = set(), {}
    for r in sorted(groups.collect(), key=lambda r: (r.gen, r.first_seen)):
        gen, seen = want.setdefault("at", (r.gen, set()))
        if gen != r.gen:
            before = seen
            want["at"] = (r.gen, set())
        now = want["at"][1]
        if r.key[0] in before or len(before | now) < 3:
            now.add(r.key[0])
            want[r.gen, r.key[0]] = True
    want.pop("at")
    assert {(r.gen, r.key[0]) for r in limit.admissions(groups, 3).where("admitted").collect()} == set(want)


def test_snapshots_of_two_generations(spark, tmp_path):
    spec = StreamSpec(interval="10m", group_by=("foo",), group_limit=2)
    df = at(spark, [({"foo": "old"}, 0), ({"foo": "a"}, 11), ({"foo": "b", "v": "1"}, 12), ({"foo": "a", "v": "2"}, 16), ({"foo": "c"}, 17), ({"foo": "b", "v": "1"}, 18), ({"foo": "d"}, 21)])
    now = 1_704_067_200_000_000 + 19 * MINUTE
    one = sketches.snapshot(df, spec, now, "n0")
    sketches.write(one, str(tmp_path / "n0"))
    sketches.write(sketches.snapshot(df.where("arrival in (1, 4)"), spec, now, "n1"), str(tmp_path / "n1"))
    alone, _ = sketches.read(spark, [str(tmp_path / "n0")])
    assert counts(sketches.merged(alone).select("key", "value")) == {("a",): 2, ("b",): 1}
    assert tuple(sketches.merged_limits(alone).first()) == ("10m0s", "foo", 2, 1, 3, 2)
    found, lost = sketches.read(spark, [str(tmp_path / f"n{i}") for i in range(3)])
    assert len(lost) == 1 and counts(sketches.merged(found).select("key", "value")) == {("a",): 2, ("b",): 1, ("c",): 1}
    assert tuple(sketches.merged_limits(found).first()) == ("10m0s", "foo", 3, 0, 3, 2)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|CANNOT_READ"):
        sketches.read(spark, [str(tmp_path / "bad")])
    whole = sketches.snapshot(df, StreamSpec(interval="10m"), now)
    assert counts(sketches.merged(whole).select("key", "value")) == {(): 4}


def test_the_job_step_by_step(spark, tmp_path):
    """Requests as a stream, in steps of any size, give the lines of one step; limits hold as in the rule."""
    from datetime import datetime, timedelta

    from seriescope.streaming import job

    rng = random.Random(31)
    requests, trace = [], {}
    for i in range(24):
        minute = i  # five requests for each generation
        series = [(rng.choice("abcdefg"), str(rng.randrange(3))) for _ in range(rng.randrange(1, 4))]
        trace.setdefault(minute // 5, []).extend(series)
        requests.append((i, datetime(2024, 1, 1) + timedelta(minutes=minute), bytearray(wire.encode([[("foo", k), ("v", v)] for k, v in series], "zstd" if i % 2 else "snappy"))))
    df = spark.createDataFrame(requests, "request long, ts timestamp, body binary").coalesce(1)
    specs = load("streams:\n- {interval: 10m, group_by: [foo], group_limit: 3}\n- {interval: 10m}\n- {interval: 20m, group_by: [foo, v]}\n")
    shown, live, dropped = model(trace, 3)[4]
    want = {f'cardinality_estimate{{interval="10m0s",group_by_keys="foo",group_by_values="{k}",by_foo="{k}"}} {n}' for k, n in shown.items()}
    want |= {f'cardinality_estimate{{interval="10m0s",group_by_keys="__group__",group_by_values="foo"}} {live + dropped}', 'cardinality_group_limit{interval="10m0s",group_by_keys="__group__",group_by_values="foo"} 3'}
    for k, cuts in enumerate(([24], [5, 10, 15, 20, 24], [3, 4, 11, 17, 22, 24])):
        said, start = [], 0
        step = job.stepper(str(tmp_path / f"job{k}"), specs, lambda out, epoch: said.append({r.line for r in out.collect()}))
        for epoch, end in enumerate(cuts):
            step(df.where((F.col("request") >= start) & (F.col("request") < end)), epoch)
            start = end
        assert want <= said[-1]
        rest = {x for x in said[-1] if 'interval="10m0s"' not in x}
        first = rest if k == 0 else first
        assert rest == first and {x for x in said[-1] if "__global__" in x} == {f'cardinality_estimate{{interval="10m0s",group_by_keys="__global__"}} {len(set(trace[3]) | set(trace[4]))}'}
    for i in range(0, 24, 8):
        df.where((F.col("request") >= i) & (F.col("request") < i + 8)).write.parquet(str(tmp_path / "in" / f"part={i:02d}"))
    said = []
    stream = spark.readStream.schema("request long, ts timestamp, body binary, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job.start(stream.drop("part"), specs, str(tmp_path / "stream"), lambda out, epoch: said.append({r.line for r in out.collect()}), once=True).awaitTermination()
    assert len(said) == 3 and want | first <= said[-1]
    series = job.arrived(df.unionAll(spark.createDataFrame([(99, datetime(2024, 1, 1), bytearray(b"\xff\xff"))], df.schema)), specs)
    state = job.advance(None, series.where("error is null").drop("error"), specs)
    got = {r.name: r.value for r in job.counters(series, df, state, specs).collect()}
    n = sum(map(len, trace.values()))
    assert got == {"write_requests_total": 24, "parser_rows_total": n, "parser_errors_total": 1, "inserts_total": 3 * n, "rejected_groups": dropped}


def test_alerts_and_matchers(spark):
    from datetime import datetime, timedelta

    rows = [("x", datetime(2024, 1, 1) + timedelta(minutes=m), v) for m, v in ((0, 9), (5, 9), (10, 9), (15, 1), (20, 9), (25, 9), (40, 9))]
    df = spark.createDataFrame(rows, "job string, as_of timestamp_ntz, value long")
    got = [(r.since.minute, r.until.minute) for r in analytics.alerts(df, F.col("value") > 5, 300, 300, ["job"]).orderBy("since").collect()]
    assert got == [(0, 10), (20, 25)]
    names = spark.createDataFrame([("abc",), ("ab",), (None,)], "n string")
    pick = lambda op, t: sorted(r.n or "" for r in names.where(analytics.matches("n", op, t)).collect())
    assert pick("=~", "a.") == ["ab"] and pick("!~", "a.*") == [""] and pick("=", "") == [""] and pick("!=", "ab") == ["", "abc"]
    usage = analytics.limit_usage(df.where("value = 9").limit(1), df.where("value = 9").limit(1).withColumn("value", F.lit(0)), "job", "as_of").first()
    assert usage.usage is None


def test_cached_result(spark):
    made, now = [], [0.0]
    cached = runner.CachedResult(lambda: made.append(1) or spark.range(2), 30, lambda: now[0])
    assert len(cached.get()) == 2 and cached.get() and len(made) == 1
    now[0] = 31
    assert cached.get() and len(made) == 2
    assert flat(estimate.cardinality(at(spark, cross(1, 1, 1)), ("foo",)), ("foo",)).columns == ["by_foo", "value"]


def test_windowed_sketches_have_the_last_window_of_each_group(spark):
    spec = StreamSpec(interval="2m", group_by=("foo",))
    rows = cross(3, 0, 4, minute=0) + cross(2, 0, 5, minute=1) + cross(1, 0, 2, seed="new", minute=5)
    got = {(tuple(r.key), r.gen): (r.value, r.within_bound, r.live) for r in windows.windowed_sketches(at(spark, rows), spec).collect()}
    first = min(g for _, g in got)
    assert {(k[0], g - first): v[::2] for (k, g), v in got.items()} == {
        ("0", 0): (4, True), ("1", 0): (4, True), ("2", 0): (4, True), ("0", 1): (5, True), ("1", 1): (5, True), ("2", 1): (4, False), ("0", 2): (5, False), ("1", 2): (5, False), ("new0", 5): (2, True), ("new0", 6): (2, False),
    }
    assert all(v[1] for v in got.values())
