"""Streams give what the batch operators give."""

import datetime
import random

from pyspark.sql import functions as F

from cuelens.lexicon import CORPUS
from cuelens.operators import history
from cuelens.streaming import live

T0 = datetime.datetime(2026, 1, 1)


def landed(spark, tmp_path):
    rows = [(i, i % 3, T0 + datetime.timedelta(hours=h)) for i, h in enumerate([0, 1, 2, 5, 7, 8, 30, 31, 400, 401, 402, 800])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df


def test_rate_limit_stream(spark, tmp_path):
    df = landed(spark, tmp_path)
    stream = live.limit_hits(live.read_folder(spark, str(tmp_path / "in"), "event_id long, user_id long, ts timestamp"), "user_id", "ts", 6 * 3600, 2)
    live.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("user_id", "opened").agg(F.max("n").alias("n"))
    want = history.rate_windows(df, "user_id", "ts", 6 * 3600, 2).select("user_id", F.col("opened").cast("timestamp"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silence_stream(spark, tmp_path):
    df = landed(spark, tmp_path)
    stream = live.silences(live.read_folder(spark, str(tmp_path / "in"), "event_id long, user_id long, ts timestamp"), "user_id", "ts")
    live.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", "ts", "prior_count", "gap_days", "silent")
    want = history.silence(df, ["user_id"], "ts").where("prior_count > 0").select("user_id", "ts", "prior_count", "gap_days", "silent")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_screening_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a text of some length without cues"), (2, "write to a.b@c.org or 10.0.0.1, Licensed under MIT")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = live.screen(live.read_folder(spark, str(tmp_path / "docs"), "doc_id long, text string"), CORPUS).select("doc_id", "intake")
    live.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert dict(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == {1: "reject_thin", 2: "admit"}


def test_restart_goes_on(spark, tmp_path):
    kind = "event_id long, user_id long, ts timestamp"
    rows = [(i, 1, T0 + datetime.timedelta(hours=h)) for i, h in enumerate([0, 1, 2, 3])]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = live.limit_hits(live.read_folder(spark, str(tmp_path / "in"), kind), "user_id", "ts", 6 * 3600, 2, delay="1 hour")
        live.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_history_is_read_by_later_runs(spark, tmp_path):
    """Each run counts what the runs before it stored, and touches the counts of its own subjects alone."""
    kind = "id long, subject string"
    touched = []
    for day in (1, 2, 3):
        new = [(day * 1000 + i, f"t{day}-{i}") for i in range(200 if day == 1 else 2)]
        spark.createDataFrame([(day, "s"), (day + 100, "s"), *new], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = live.run_once(live.with_history(live.read_folder(spark, str(tmp_path / "in"), kind), "subject"), str(tmp_path / "store"), str(tmp_path / "cp"))
        touched.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    got = {r.id: r.prior for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert [got[i] for i in (1, 101, 2, 102, 3, 103, 1000, 3001)] == [0, 0, 2, 2, 4, 4, 0, 0]
    assert touched == [201, 3, 3]


def test_registry_evicts_the_oldest(spark, tmp_path):
    """Against a map in order of opening: windows that are over go, then the oldest beyond the bound; over restarts."""
    rng, at, hits = random.Random(7), 0, []
    for _ in range(400):
        at += rng.choice([0, 1, 1, 7, 90])
        hits.append((f"k{rng.randrange(9)}", T0 + datetime.timedelta(seconds=at)))
    hits = sorted(hits, key=lambda h: (h[1], h[0]))
    cut = next(i for i in range(200, 400) if hits[i][1] != hits[i - 1][1])
    held, want = {}, []
    for k, t in hits:
        if k not in held or t >= held[k][0] + datetime.timedelta(seconds=100):
            held = {x: v for x, v in held.items() if v[0] + datetime.timedelta(seconds=100) > t}
            while len(held) >= 4:
                del held[next(iter(held))]
            held[k] = [t, 0]
        held[k][1] += 1
        want.append((k, t, held[k][0], held[k][1], held[k][1] <= 3))
    for part in (hits[:cut], hits[cut:]):
        spark.createDataFrame(part, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.run_once(live.limit_registry(live.read_folder(spark, str(tmp_path / "in"), "k string, ts timestamp"), "k", "ts", 100, 3, 4), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)


def test_timers_end_state(spark, tmp_path):
    """Windows and silences that are over by the watermark are forgotten: state shrinks, and a subject that returns is new."""
    kind = "s string, ts timestamp, band string"
    days = lambda *ds: [(s, T0 + datetime.timedelta(days=d), b) for s, d, b in ds]
    parts = [days(("a", 0, "thin"), ("a", 20, "thin"), ("b", 20, "dense")), days(("b", 45, "dense"), ("b", 70, "thin")), days(("z", 200, "thin")), days(("z", 201, "thin")), days(("a", 202, "thin"), ("z", 230, "thin"))]
    size = {}
    for name, made in (("silences", lambda r: live.silences(r, "s", "ts", 14, "band", "1 day", 60)), ("limits", lambda r: live.limit_hits(r, "s", "ts", 3600, 1, "1 day"))):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / name / f"part={k}"))
            stream = live.read_folder(spark, str(tmp_path / name / "part=*"), kind)
            query = live.run_once(made(stream), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"))
            size[name] = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    got = {(r.s, (r.ts - T0).days, r.prior_count, r.gap_days, r.silent) for r in spark.read.parquet(str(tmp_path / "silences-out")).collect()}
    assert got == {("a", 20, 1, 20, True), ("b", 45, 1, 25, False), ("b", 70, 2, 25, True), ("z", 201, 1, 1, False), ("z", 230, 2, 29, True)}
    assert spark.read.parquet(str(tmp_path / "limits-out")).count() == 9 and size["limits"] < 6


def test_cooldown_by_provider(spark):
    """Random calls of several providers against the rule call by call; no call meets all refusals."""
    rng, calls = random.Random(11), []
    for who in ("a", "b", None):
        at = 0
        for _ in range(150):
            at += rng.choice([0, 1, 5, 20, 60, 61, 200])
            calls.append((who, T0 + datetime.timedelta(seconds=at), rng.choice([200, 429, 429, None])))
    want, until = [], {}
    for who, t, status in sorted(calls, key=lambda c: c[1]):
        last = until.get(who)
        allowed = last is None or t <= last or t > last + datetime.timedelta(seconds=60)
        if allowed and status == 429 and (last is None or t > last):
            until[who] = t
        want.append((who, t, status, allowed))
    # a call at the very time of the refusal that starts a cooldown is not after it
    table = spark.createDataFrame(calls, "who string, ts timestamp, status int")
    found = live.cooled(table, "ts", "status", 60, "who")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    key = lambda r: (r[0] or "", *r[1:2], r[2] or 0, r[3])
    assert sorted(map(key, found.collect())) == sorted(map(key, want))


def test_cooldown_and_pastes_once(spark, tmp_path):
    calls = [(T0 + datetime.timedelta(seconds=s), status) for s, status in [(0, 200), (10, 429), (30, 429), (70, 200), (71, 200), (100, 429), (130, 200)]]
    got = live.cooled(spark.createDataFrame(calls, "ts timestamp, status int"), "ts", "status").orderBy("ts").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, False]
    spark.createDataFrame([(1, "a b", T0), (2, "ab", T0), (3, "c", T0)], "doc_id long, text string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.once(live.read_folder(spark, str(tmp_path / "in"), "doc_id long, text string, ts timestamp"), "ts")
    live.run_once(stream.select("doc_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_delivery_sends_once(spark, tmp_path):
    """A receiver that fails at first: what it took is not sent again, by a later batch, a batch that is run again, or a restart."""
    from cuelens.streaming import delivery

    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def send(key, payload, inbox=str(inbox)):
        import os
        import uuid

        seen = sum(f.startswith(f"{key}-try") for f in os.listdir(inbox))
        open(os.path.join(inbox, f"{key}-try{uuid.uuid4().hex}"), "w").close()
        if payload.startswith("bad") or (payload.startswith("slow") and seen == 0):
            raise OSError("not now")
        open(os.path.join(inbox, f"{key}-took{uuid.uuid4().hex}"), "w").write(payload)

    took = lambda: sorted(f.read_text() for f in inbox.iterdir() if "-took" in f.name)
    ledger, kind = str(tmp_path / "ledger"), "id string, payload string"
    each = delivery.deliver(send, ledger, tries=2, pause=0.0)
    for part in ([("1", "a"), ("1", "a"), ("2", "slow b"), ("3", "bad c"), ("4", None)], [("1", "a"), ("5", "d"), ("3", "bad c")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.run_once(live.read_folder(spark, str(tmp_path / "in"), kind), "", str(tmp_path / "cp"), each)
    assert took() == ["a", "d", "slow b"]
    rows = delivery.read_ledger(spark, ledger).collect()
    assert {(r.id, r.taken, r.tries) for r in rows} == {("1", True, 1), ("2", True, 2), ("3", False, 2), ("5", True, 1)} and len(rows) == 5
    each(spark.createDataFrame([("1", "a"), ("2", "slow b"), ("3", "bad c")], kind), 0)  # the first batch again
    assert took() == ["a", "d", "slow b"] and {r.id for r in delivery.read_ledger(spark, ledger).where("taken").collect()} == {"1", "2", "5"}
