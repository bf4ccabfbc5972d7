"""The line and event grammar on written-out lines."""

import json

from chronoloom.plans import route, timeline
from chronoloom.sources import logs


def parse(spark, *lines):
    raw = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "session_id long, seq long, line string")
    return [r.asDict() for r in route.parsed(raw).orderBy("seq").collect()]


def test_plain_and_event_lines(spark):
    a, b, c = parse(
        spark,
        "12.000345 [TRACE ] radio: channel 11 (rssi [-40]) ready at 0x3fc8",
        " 7.5\t[ warn ] @EVENT_EMBASSY_TASK_EXEC_END(executor_id=4096, core_id=1, task_id=00077)\r",
        "\u2003 0.1 [Info]\u00a0@EVENT_MONITOR_END(function_name = blink ,core_id=+3)\u3000",
    )
    assert (a["ts_us"], a["level"], a["message"], a["kind"]) == (12000345, "TRACE", "radio: channel 11 (rssi [-40]) ready at 0x3fc8", None)
    assert (b["ts_us"], b["level"], b["kind"], b["core_id"], b["executor_id"], b["task_id"]) == (7500000, "WARN", "EVENT_EMBASSY_TASK_EXEC_END", 1, 4096, 77)
    assert (c["ts_us"], c["level"], c["kind"], c["core_id"], c["name"]) == (100000, "INFO", "EVENT_MONITOR_END", 3, "blink")


def test_params_of_odd_lists(spark):
    texts = ["a=1,b=2", "a=1,a=2,a=3", "a,b=,=x, c = y z =w ", "", ",,=", "k\n=v\n,k2=\u2003w\u2003"]
    df = spark.createDataFrame([(t,) for t in texts], "args string")
    from pyspark.sql import functions as F

    from chronoloom.functions.parse import param, parse_params, value

    got = [r["m"] for r in df.select(parse_params(F.col("args")).alias("m")).collect()]
    want = []
    for t in texts:
        pieces = [p.split("=", 1) for p in t.split(",") if "=" in p]
        want.append({k.strip(): v.strip() for k, v in pieces})
    assert got == want
    for key in ("a", "b", "c", "k", "k2"):
        assert [r["v"] for r in df.select(value(param(F.col("args"), key)).alias("v")).collect()] == [w.get(key) for w in want]


def test_numbers(spark):
    from pyspark.sql import functions as F

    from chronoloom.functions.parse import real, unsigned

    texts = ["1", "+5", "-1", "1.0", " 7", "4294967295", "4294967296", "00000000000000000000000009", "99999999999999999999", "", "1e3", ".5", "5.", ".", "1.5f", "1d", "0x1", "inf", "-Infinity", "+NaN", "in", "1e400"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(unsigned(F.col("t"), 32).alias("u"), real(F.col("t")).alias("r")).collect()
    assert [r["u"] for r in rows] == [1, 5, None, None, None, 4294967295, None, 9, *[None] * 14]
    want = [1.0, 5.0, -1.0, 1.0, None, 4294967295.0, 4294967296.0, 9.0, 99999999999999999999.0, None, 1000.0, 0.5, 5.0, None, None, None, None, float("inf"), float("-inf"), "nan", None, float("inf")]
    assert ["nan" if r["r"] is not None and r["r"] != r["r"] else r["r"] for r in rows] == want


def test_rejects(spark):
    rows = parse(spark, "garbage", "] 1.0 [INFO] x", "1.0 [] x", "1.0 [NOTICE] x", "abc [INFO] x", "-1.0 [INFO] x", "nan [INFO] x", "1e30 [INFO] x", None)
    assert all(r["reject_reason"] and r["message"] is None for r in rows)


def test_first_brackets_win(spark):
    (r,) = parse(spark, "1.0 [INFO ] [fan] turns slowly")
    assert r["message"] == "[fan] turns slowly" and r["kind"] is None and r["event_parse_error"] is None


def test_event_edges(spark):
    head = "1.0 [INFO] @EVENT_"
    rows = parse(
        spark,
        "1.0 [ERROR] @EVENT_METRIC(name=t,value=1e3,core_id=1) extra",
        head + "METRIC(name=t,value=NaN,core_id=1)",
        head + "MONITOR_START(function_name=a,b,core_id=0)",
        head + "MONITOR_START(function_name=a=b,core_id=0)",
        head + "MONITOR_START(core_id=1,function_name=f,core_id=0)",
        head + "METRIC(name=t,value=1.5f,core_id=1)",
        head + "METRIC(name=t,value=true,core_id=1)",
        head + "METRIC(name=t,value=1,core_id=256)",
        head + "METRIC(name=t,value=1,core_id=-1)",
        head + "EMBASSY_POLL_START(executor_id=4294967296, core_id=0)",
        head + "MONITOR_START(function_name=f(x),core_id=0)",
        head + "UNKNOWN(core_id=0)",
        "1.0 [INFO] @x)(",
    )
    assert rows[0]["value"] == 1000.0 and rows[1]["value"] != rows[1]["value"]
    assert [r["name"] for r in rows[2:5]] == ["a", "a=b", "f"] and rows[4]["core_id"] == 0
    assert all(r["kind"] is None and r["event_parse_error"] and r["reject_reason"] is None for r in rows[5:])


def test_timeline_documents(spark, tmp_path):
    lines = [
        "0.000001 [INFO] @EVENT_EMBASSY_POLL_START(executor_id=1, core_id=0)",
        "0.000002 [INFO] @EVENT_EMBASSY_TASK_EXEC_BEGIN(executor_id=1, core_id=0, task_id=7)",
        "0.000003 [INFO] @EVENT_METRIC(name=m,value=inf,core_id=0)",
        '0.000004 [WARN] quote " here',
        "no line",
    ]
    raw = spark.createDataFrame([(s, i, x) for s in (1, 2) for i, x in enumerate(lines)], "session_id long, seq long, line string")
    events, plain, rejects = route.route_lines(raw)
    assert rejects.count() == 2
    from chronoloom.operators.replay import replay

    logs.write_trace_json(timeline.trace_events(events, plain, replay(events)), str(tmp_path / "out"))
    for session in (1, 2):
        (part,) = [p for p in (tmp_path / "out" / f"session_id={session}").iterdir() if p.suffix == ".txt"]
        found = json.loads(part.read_text())["traceEvents"]
        assert found[0]["args"]["name"] == "CORE OVERVIEW"
        counter = next(r for r in found if r["ph"] == "C")
        assert counter["args"] == {"value": None} and counter["pid"] == 1
        assert [r["name"] for r in found if r["ph"] == "i"] == ['quote " here']
        assert [r.get("name") for r in found if r["ph"] in "BE" and r["pid"] == 1 and "tid" not in r] == ["Created", None, "Scheduling", None, "Polling"]


def test_read_logs_keeps_order(spark, tmp_path):
    folder = tmp_path / "session_id=5"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(f"line {i}" for i in range(3000)) + "\nlast without end")
    rows = logs.read_logs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["line"] for r in rows] == [f"line {i}" for i in range(3000)] + ["last without end"] and rows[0]["session_id"] == 5


def test_equal_records_of_one_place_give_valid_json(spark, tmp_path):
    raw = spark.createDataFrame([(1, 0, "1.0 [INFO] same"), (1, 0, "1.0 [INFO] same"), (1, 0, "1.0 [INFO] same"), (2, 5, "1.0 [INFO] alone")], "session_id long, seq long, line string")
    logs.write_trace_json(timeline.log_instants(route.route_lines(raw)[1]), str(tmp_path / "out"))
    for session, n in ((1, 3), (2, 1)):
        (part,) = [p for p in (tmp_path / "out" / f"session_id={session}").iterdir() if p.suffix == ".txt"]
        assert len(json.loads(part.read_text())["traceEvents"]) == n


def test_lines_of_many_blocks_keep_their_order(spark, tmp_path):
    for session in (1, 2):
        (tmp_path / f"session_id={session}").mkdir()
        for f in range(3):
            (tmp_path / f"session_id={session}" / f"{f}.log").write_text("".join(f"{session} {f} line {i}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = logs.read_logs(spark, str(tmp_path)).orderBy("session_id", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["session_id"], r["seq"], r["line"]) for r in rows] == [(s, f * 4000 + i, f"{s} {f} line {i}") for s in (1, 2) for f in range(3) for i in range(4000)]


def test_stopped_stream_leaves_whole_tables(spark, tmp_path):
    from chronoloom.streaming.route import stop, stream_route

    lines = [(1, i, x) for i, x in enumerate(["1.0 [INFO] @EVENT_EMBASSY_POLL_START(executor_id=1, core_id=0)", "2.0 [WARN] plain", "junk", "3.0 [INFO] more"])]
    for k in range(2):
        spark.createDataFrame(lines[2 * k : 2 * k + 2], "session_id long, seq long, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = logs.read_log_stream(spark, "parquet", {"maxFilesPerTrigger": "1"}, str(tmp_path / "in"))
    stop(stream_route(stream, str(tmp_path / "out"), str(tmp_path / "state"), processingTime="100 milliseconds"))
    seqs = lambda name: sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out" / name)).collect())
    assert (seqs("events"), seqs("lines"), seqs("rejects")) == ([0], [1, 3], [2])
    lines_, rejects = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("lines", "rejects"))
    assert [r["text"] for r in logs.passthrough(lines_, rejects).orderBy("seq").collect()] == ["2.000000 [WARN] plain", "junk", "3.000000 [INFO] more"]
