import json

from pyspark.sql import functions as F

from lorequarry.sources import stores, transcripts
from lorequarry.streaming import incremental


def test_codex_tool_calls(spark, tmp_path):
    rows = [
        {"type": "session_meta", "payload": {"cwd": "/w"}, "timestamp": "2026-01-01T00:00:00Z"},
        {"type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "arguments": json.dumps({"command": "npm test", "timeout": 30000})}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "read_file", "arguments": "not json"}},
        {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "be brief"}]}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    lines = transcripts.raw_lines(spark, str(tmp_path))
    calls = {r["tool_name"]: json.loads(r["input"]) for r in transcripts.tool_calls(lines).collect()}
    assert calls == {"exec_command": {"command": "npm test", "timeout": 30000}, "read_file": {"raw": "not json"}}
    said = transcripts.messages(lines).collect()
    assert [(r["session_id"], r["line_number"], r["role"], r["content"], r["project_path"]) for r in said] == [("s1", 4, "system", "be brief", "/w")]


def test_formats_agree(spark, tmp_path):
    claude = [{"type": "user", "message": {"role": "user", "content": "<system-reminder>x</system-reminder> hello"}, "cwd": "/w"}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "name": "read_file", "input": {"path": "p"}}]}}]
    kiro = [{"type": "user", "message": {"role": "human", "content": "hello"}, "cwd": "/w"}, {"type": "assistant", "message": {"role": "assistant", "content": "a\nb"}}, {"type": "tool_call", "name": "read_file", "arguments": '{"path": "p"}'}]
    found = []
    for name, rows in (("one", claude), ("two", kiro)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
        lines = transcripts.raw_lines(spark, str(tmp_path / name))
        said = [(r["role"], r["content"]) for r in transcripts.messages(lines).orderBy("line_number").collect()]
        calls = [(r["tool_name"], json.loads(r["input"])) for r in transcripts.tool_calls(lines).collect()]
        found.append((said, calls))
    assert found[0] == found[1] == ([("user", "hello"), ("assistant", "a\nb")], [("read_file", {"path": "p"})])


def test_resume_and_changes(spark):
    messages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "session_id string, line_number long")
    progress = spark.createDataFrame([("a", 1)], "session_id string, last_line long")
    assert sorted(map(tuple, transcripts.resumed(messages, progress).select("session_id", "line_number").collect())) == [("a", 2), ("b", 1)]


def test_stores(spark, tmp_path):
    (tmp_path / "r.md").write_text("---\nid: rule-007\ntype: preference\n---\n## Description\nUse it.\n## Steps\n- one\n- two\n")
    rule = stores.read_rules(spark, str(tmp_path)).first()
    assert (rule["meta"]["id"], rule["description"], rule["steps"]) == ("rule-007", "Use it.", ["one", "two"])
    ids = spark.createDataFrame([("rule-007",), ("x",)], "rule_id string")
    assert stores.next_rule_id(ids).first()["rule_id"] == "rule-008"
    (tmp_path / "s.json").write_text(json.dumps({"signals": [{"text": "should", "language": "en", "pattern_type": "correction", "confidence": 0.8}]}))
    assert stores.read_signals(spark, str(tmp_path / "s.json")).first()["confidence"] == 0.8
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, pos long, v string")
    assert sorted(r["v"] for r in stores.replayed(log, "id", "pos").collect()) == ["y", "z"]


def test_next_rule_id_keeps_all_digits(spark, same_as_sql, tmp_path):
    from lorequarry.plans import queries_sources

    ids = spark.createDataFrame([("rule-99999",), ("rule-20000000000",)], "rule_id string")
    assert stores.next_rule_id(ids).first()["rule_id"] == "rule-20000000001"
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 123400).coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "part.parquet")
    assert same_as_sql(queries_sources.QUERIES["next_rule_id"], queries_sources.ORACLE_SQL["next_rule_id"], str(tmp_path)) == 1


def test_json_repair(spark):
    texts = ["```json\n{\"a\": 1,}\n```", "so: {'a': 1}", "[1, 2,]", "nothing"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["j"] for r in rows.select("i", F.to_json(stores.repaired_json(F.col("t"))).alias("j")).collect()}
    assert found == {0: '{"a":1}', 1: '{"a":1}', 2: "[1,2]", 3: None}


def test_weekly_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.select("ts", F.col("event_type").alias("feedback_type")).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, feedback_type string").parquet(str(tmp_path / "in"))
    query = incremental.usage_by_week(stream).writeStream.outputMode("complete").format("memory").queryName("weekly").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(n) as n from weekly").first()["n"] == events.count()
    assert spark.sql("select count(*) as n from weekly where weekday(week.start) <> 0").first()["n"] == 0


def test_profile_stream_equals_the_batch(spark, sf, tmp_path):
    from lorequarry.plans import catalog

    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    incremental.use_state_store(spark)
    query = incremental.running_profiles(stream).writeStream.outputMode("update").format("memory").queryName("profiles").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["user_id"]: round(r["mean"], 4) for r in spark.sql("select * from profiles").collect()}
    want = {r["user_id"]: round(r["mean"], 4) for r in catalog.QUERIES["profile_ema"](spark, sf).collect()}
    assert got == want


def test_lines_of_a_large_file_keep_their_numbers(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("\n".join(json.dumps({"type": "user", "message": {"role": "user", "content": f"line {i} " + "x" * 50}}) if i % 10 else "" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = transcripts.messages(transcripts.raw_lines(spark, str(tmp_path))).select("line_number", "content").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 2700 and all(r["content"].startswith(f"line {r['line_number']} ") for r in found)


def test_whole_files_and_sidecars(spark, tmp_path):
    folder = tmp_path / ".kiro" / "sess_abc"
    folder.mkdir(parents=True)
    (folder / "messages.json").write_text(json.dumps({"messages": [{"type": "prompt", "role": "prompt", "content": "go"}, {"event": "tool_call", "payload": {"toolName": "read", "args": {"p": 1}}}, {"type": "tool_result", "callId": "c1", "payload": {"output": "done"}}], "x": 1}, indent=2))
    (folder / "abc.history").write_text("ls\n\ncat x\n")
    root = str(tmp_path / ".kiro")  # given as the root, as Spark passes hidden folders below one over
    lines = transcripts.whole_records(spark, root)
    assert [(r["session_id"], r["line_number"], r["role"], r["content"]) for r in transcripts.messages(lines).collect()] == [("abc", 1, "user", "go")]
    assert [(r["tool_name"], r["input"]) for r in transcripts.tool_calls(lines).collect()] == [("read", '{"p":1}')]
    assert [(r["call_id"], r["content"]) for r in transcripts.tool_outputs(lines).collect()] == [("c1", "done")]
    assert [(r["session_id"], r["line_number"], r["command"]) for r in transcripts.histories(spark, root).orderBy("line_number").collect()] == [("abc", 1, "ls"), ("abc", 3, "cat x")]


def test_stores_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([("r1", "k", 0.5, "use it"), ("r2", "k", 0.9, "avoid it")], "rule_id string, kind string, confidence double, content string")
    for _ in range(2):
        stores.save_index(rules, str(tmp_path / "index"))
    assert sorted(map(tuple, stores.load_index(spark, str(tmp_path / "index"), "rule_id string, kind string, confidence double, content string").collect())) == sorted(map(tuple, rules.collect()))
    given = spark.createDataFrame([("r1", None, "used", None, 5, "u", None)], stores.FEEDBACK)
    for _ in range(2):
        stores.append_feedback(given, str(tmp_path / "log"))
    assert stores.read_feedback(spark, str(tmp_path / "log")).count() == 2
    assert [r["line"] for r in stores.exported(rules, "kind").orderBy("place").collect()] == ["## k", "- avoid it (0.90)", "- use it (0.50)"]


def test_arrays_that_were_cut_off(spark):
    texts = ['[{"a": 1}, {"b": "]}"}', '[{"a": 1}, {"b": [1, 2', '[1, 2]', "[", '[{"a": "x\\"]"}, {"b']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r["i"]: json.loads(r["j"]) for r in rows.select("i", stores.recovered_array(F.col("t")).alias("j")).collect()}
    assert found == {0: [{"a": 1}, {"b": "]}"}], 1: [{"a": 1}], 2: [1, 2], 3: [], 4: [{"a": 'x"]'}]}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "session_id long, line_number long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, rows in enumerate(([(1, 5), (2, 1)], [(1, 3), (3, 9)], [(2, 8)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = incremental.log_sessions(stream, str(tmp_path / "log"), str(tmp_path / f"c{k // 2}")).start()
        query.processAllAvailable()
        query.stop()
    want = {1: 5, 2: 8, 3: 9}
    assert {r["session_id"]: r["last_line"] for r in incremental.sessions(spark, str(tmp_path / "log")).collect()} == want
    incremental.compacted(spark, str(tmp_path / "log"), str(tmp_path / "one"))
    assert {r["session_id"]: r["last_line"] for r in spark.read.parquet(str(tmp_path / "one")).collect()} == want


def test_daily_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("ts", F.col("event_type").alias("feedback_type")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, feedback_type string").parquet(str(tmp_path / "in"))
    query = incremental.usage_by_day(stream).writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(str(r["d"]), r["feedback_type"]): r["n"] for r in spark.sql("select to_date(day.start) as d, feedback_type, n from daily").collect()}
    assert got == {(str(r["d"]), r["event_type"]): r["n"] for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
