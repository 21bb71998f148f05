"""Streams give what the batch operators give."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from agentsec.operators import analytics as A
from agentsec.operators import sessions as W
from agentsec.sources import tail
from agentsec.sources.views import security_events, tool_calls
from agentsec.streaming import events as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def calls(spark):
    return tool_calls(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).cache()


def streamed(spark, df, tmp_path, parts=3):
    """`df` as a stream of files, in time order."""
    for k, one in enumerate(df.orderBy("ts", "id").randomSplit([1.0] * 1)):
        one.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_hourly_counts(spark, calls, tmp_path):
    got = run(X.hourly_counts(streamed(spark, calls, tmp_path)), tmp_path, "hourly", "complete")
    assert {(r.hour, r.n) for r in got.collect()} == {(r.hour, r.n) for r in A.events_per_hour(calls).collect()}


def test_session_state_equals_windows(spark, calls, tmp_path):
    cols = ["id", "taint_level", "calls", "file_writes", "shell_commands", "web_fetches", "mcp_calls", "consecutive", "total_bytes", "spend_level", "escalation"]
    rows = W.spend(W.egress(W.consecutive(W.trajectory(W.taint(calls.withColumn("bytes", F.coalesce("bytes", F.lit(0))))))))
    want = {tuple(r) for r in W.escalation(rows, F.col("severity") == "CRITICAL", F.col("severity") == "HIGH").select(*cols).collect()}
    assert {tuple(r) for r in X.session_fold(calls).select(*cols).collect()} == want
    got = run(X.session_states(streamed(spark, calls, tmp_path)), tmp_path, "states")
    assert {tuple(r) for r in got.select(*cols).collect()} == want


def test_rows_come_in_order_over_batches():
    rng = random.Random(3)
    rows = [(pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rng.randrange(50)), k, "Bash") for k in range(500)]
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["ts", "id", "tool_name"])
    for size in (500, 37, 1):
        got = list(X.in_order(frame[k : k + size] for k in range(0, 500, size)))
        assert [(r["ts"], r["id"], r["tool_name"]) for r in got] == sorted(rows)
    assert list(X.in_order(iter([]))) == []


def test_session_of_many_batches(spark, calls, tmp_path):
    """A session's rows in many Arrow batches give the same results."""
    one = calls.withColumn("session_id", F.when(F.col("id") % 3 == 0, F.lit("s1")).otherwise(F.col("session_id"))).withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    cols = ["session_id", "id", "calls", "total_bytes", "consecutive", "taint_level", "spend_level"]
    want = sorted(tuple(r) for r in W.spend(W.egress(W.consecutive(W.trajectory(W.taint(one))))).select(*cols).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        plan = X.session_fold(one)._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroups" not in plan
        assert sorted(tuple(r) for r in X.session_fold(one).select(*cols).collect()) == want
        got = run(X.session_states(streamed(spark, one, tmp_path)), tmp_path, "many_batches")
        assert sorted(tuple(r) for r in got.select(*cols).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sink_sessions_and_repeats(spark, calls, tmp_path):
    stream = streamed(spark, calls.unionAll(calls), tmp_path)
    assert run(X.without_repeats(stream), tmp_path, "once").count() == calls.count()
    q = X.event_sink(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * calls.count()
    windows = run(X.session_windows(stream), tmp_path, "windows", "complete")
    assert windows.agg(F.sum("n")).first()[0] == 2 * calls.count()


def tailed(spark, folder, tmp_path):
    """One run from the same checkpoint: what it added."""
    q = X.tail_audit_logs(spark, str(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/tail-out").option("checkpointLocation", f"{tmp_path}/tail-ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.file, r.tool or "", r.layer, r._bad is None) for r in spark.read.parquet(f"{tmp_path}/tail-out").collect())


def test_tail_reads_appended_lines_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log, other = folder / "governor-audit.jsonl", folder / "L9-egress-scanner-audit.jsonl"
    log.write_text('{"tool":"Bash","action":"BLOCK"}\n{"half": \n\n{"tool":"Re')
    (folder / "notes.txt").write_text('{"tool":"no"}\n')
    want = [("governor-audit.jsonl", "", "L1", False), ("governor-audit.jsonl", "Bash", "L1", True)]
    assert tailed(spark, folder, tmp_path) == want  # the half-written line is held back, not lost and not an error
    assert tailed(spark, folder, tmp_path) == want
    with log.open("a") as f:
        f.write('ad"}\n{"tool":"Edit"}\n')
    other.write_text('{"tool":"WebFetch"}\r\n')
    want = sorted([*want, ("governor-audit.jsonl", "Read", "L1", True), ("governor-audit.jsonl", "Edit", "L1", True), (other.name, "WebFetch", "L9", True)])
    assert tailed(spark, folder, tmp_path) == want
    log.write_text('{"tool":"New"}\n')  # shrunk: read from its start
    want = sorted([*want, ("governor-audit.jsonl", "New", "L1", True)])
    assert tailed(spark, folder, tmp_path) == want
    log.write_text('{"tool":"Other"}\n' * 3)  # another file of that name, longer than the one before
    want = sorted([*want, *[("governor-audit.jsonl", "Other", "L1", True)] * 3])
    assert tailed(spark, folder, tmp_path) == want
    other.unlink()
    assert tailed(spark, folder, tmp_path) == want


def test_pieces_of_a_file_hold_each_line_once(tmp_path, monkeypatch):
    rng = random.Random(5)
    lines = ["x" * rng.choice([0, 1, 3, 30]) + str(k) + "é" * rng.randrange(3) for k in range(200)] + ["", "end"]
    path = tmp_path / "a.jsonl"
    path.write_bytes(("\n".join(lines) + "\nhalf").encode())
    for block in (7, 1 << 16):
        monkeypatch.setattr(tail, "BLOCK", block)
        for split in (1, 2, 10, 64, 1 << 20):
            reader = tail.LineReader(str(tmp_path), ".jsonl", split)
            end = reader.latestOffset()
            assert end[str(path)]["end"] == len(path.read_bytes()) - 4
            for start in ({}, {str(path): end[str(path)] | {"end": len("\n".join(lines[:50]).encode()) + 1}}):
                got = [(at, line) for p in reader.partitions(start, end) for b in reader.read(p) for at, line in zip(b["at"].to_pylist(), b["line"].to_pylist())]
                assert [line for _, line in got] == [x for x in lines[50 if start else 0 :] if x]
                assert len({at for at, _ in got}) == len(got)
    assert tail.LineReader(str(tmp_path / "missing"), ".jsonl", 10).latestOffset() == {}


def test_statistics_of_the_sink_count_a_repeated_batch_once(spark, calls, tmp_path):
    half = calls.filter("id % 2 = 0"), calls.filter("id % 2 = 1")
    for k, part in enumerate(half):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out, ck = f"{tmp_path}/out", tmp_path / "ck"
    X.event_sink(stream, out, str(ck), statistics=True).awaitTermination()

    def check():
        bare = lambda df: sorted(map(str, df.collect()))
        for unit in ("hour", "day"):
            assert bare(X.sink_metrics(spark, out, unit)) == bare(A.metrics(calls, unit))
        assert bare(X.sink_patterns(spark, out)) == bare(A.pattern_statistics(calls))
        layers = spark.createDataFrame([("L0", "a"), ("L4", "b"), ("L77", "c")], "layer string, name string")
        assert bare(X.sink_layers(spark, out, layers)) == bare(A.layer_statistics(layers, calls))
        assert spark.read.parquet(f"{out}/events").count() == calls.count()

    check()
    commits = sorted((p for p in (ck / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    assert len(commits) == 2
    commits[-1].unlink()  # as if the query had died before it noted the batch: it is written again
    (ck / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    X.event_sink(stream, out, str(ck), statistics=True).awaitTermination()
    check()


def test_idle_sessions_are_evicted(spark, tmp_path):
    shape = "session_id string, id long, ts timestamp, tool_name string, file_path string, command string, bytes long, input_chars long, severity string"
    at = lambda minute: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)).to_pydatetime()
    call = lambda s, k, minute: (s, k, at(minute), "Bash", None, "ls", 10, 4000, "LOW")
    batches = [[call("a", 1, 0), call("b", 2, 5)], [call("b", 3, 50)], [call("c", 4, 200)], [call("c", 5, 210)], [call("a", 6, 215), call("c", 7, 400)], [call("c", 8, 401)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/0").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    q = X.session_states(files, idle="1 hour", late="10 minutes").writeStream.format("memory").queryName("evictions").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("evictions").collect()
    mine = lambda s: [(r.id, r.calls, r.total_bytes, r.evicted) for r in rows if r.session_id == s]
    assert mine("b") == [(2, 1, 10, False), (3, 2, 20, False), (None, 2, 20, True)]
    assert mine("a") == [(1, 1, 10, False), (None, 1, 10, True), (6, 1, 10, False), (None, 1, 10, True)]  # it came back and started anew
    assert [r.calls for r in rows if r.session_id == "c" and not r.evicted] == [1, 2, 3, 4]
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(totals) > totals[-1] > 0


def test_views(spark):
    assert security_events(spark, SF).count() == 1000
