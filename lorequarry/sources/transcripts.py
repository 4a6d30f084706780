"""Readers of chat transcripts in four formats, as messages and tool calls.

Line numbers are those of the file; a bad line is skipped. JSON is read as VARIANT, so no schema is inferred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import small, staged

# Wrapper blocks that stand before a user's own words.
WRAPPERS = ["environment_context", "user_instructions", "system-reminder", "command-message", "command-name", "local-command-stdout"]


def raw_lines(spark: SparkSession, path: str, glob: str = "*.json*") -> DataFrame:
    """path, session_id, line_number (from 1), line, record (VARIANT, null for a bad line) of all files below a folder.

    A file is read in splits, however large it is. A task numbers the lines of a split, and the lines of the
    splits before it in its file, of which there is one number each, are added.
    """
    return parsed(numbered(spark, path, glob))


def numbered(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, line_number, line of all lines, empty ones too. No lines move: the splits are counted in a scan of their own."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    placed = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, starts = batch.column("path").dictionary_encode(), batch.column("block").to_numpy()
            code = names.indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (starts[1:] != starts[:-1])]))
            place = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows)))
            head = (names.dictionary[code[0]].as_py(), int(starts[0]))
            if head == split:
                place[: first[1] if len(first) > 1 else None] += n
            split, n = (names.dictionary[code[-1]].as_py(), int(starts[-1])), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place + 1)], [*batch.schema.names, "nth"])

    splits = staged(placed.groupBy("path", "block").agg(F.count("*").alias("lines")), "splits")
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("path", "block", F.coalesce(F.sum("lines").over(order), F.lit(0)).alias("before"))
    each = placed.mapInArrow(number, "path string, block long, line string, nth long")
    return each.join(small(before), ["path", "block"]).select("path", (F.col("before") + F.col("nth")).alias("line_number"), "line")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (path, line_number, line) with their session_id and record; empty ones are left out."""
    return lines.filter(F.trim("line") != "").select("path", session_of(F.col("path")).alias("session_id"), "line_number", "line", F.try_parse_json("line").alias("record"))


def session_of(path: Column) -> Column:
    """The session by the name of its file, or of its folder where the file is messages.json."""
    folder = F.regexp_extract(path, r"([^/]+)/messages\.json$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))
    return F.regexp_replace(F.regexp_replace(name, r"\.(jsonl|json|history)$", ""), "^sess_", "")


def whole_records(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """The same of files that are one JSON value each: the records of an array, or of the list that an object wraps, numbered from 1."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return unwrapped(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")))


def unwrapped(files: DataFrame) -> DataFrame:
    value = F.try_parse_json("line")
    lists = [F.try_variant_get(value, f"$.{k}", "array<variant>") for k in ("messages", "events", "records", "conversation", "items")]
    records = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), *lists, F.when(value.isNotNull(), F.array(value)))
    each = files.select("path", F.posexplode(records).alias("at", "record"))
    return each.select("path", session_of(F.col("path")).alias("session_id"), (F.col("at") + 1).alias("line_number"), F.to_json("record").alias("line"), "record")


def histories(spark: SparkSession, path: str) -> DataFrame:
    """Commands of each session, from the .history files beside the sessions: session_id, line_number, command."""
    return raw_lines(spark, path, "*.history").select("session_id", "line_number", F.col("line").alias("command"))


def project_of_folder(path: Column) -> Column:
    """The project that a session's folder is named after, with its drive."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    drive = F.regexp_extract(parent, r"^([A-Za-z]):?-(.+)$", 1)
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":/"), F.regexp_extract(parent, r"^([A-Za-z]):?-(.+)$", 2))).when(parent != "", parent)


def detect_format(path: Column, line: Column) -> Column:
    """Format by the path, else by markers in the text; claude-code if nothing shows."""
    return (
        F.when(path.contains("/.codex/") | line.contains('"session_meta"') | line.contains('"response_item"'), "codex")
        .when(path.contains("/.kiro/") | line.contains('"tool_call"') | line.contains('"toolName"'), "kiro")
        .when(path.contains("/.workbuddy/") | line.contains('"type":"message"'), "workbuddy")
        .otherwise("claude-code")
    )


def sanitised(content: Column) -> Column:
    """The text without leading wrapper blocks."""
    out = content
    for name in WRAPPERS:
        out = F.regexp_replace(out, rf"(?s)^\s*<{name}>.*?</{name}>", "")
    return F.trim(out)


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def block_text(content: Column) -> Column:
    """A string, or the text blocks of an array joined by newlines."""
    blocks = _get(content, "$", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.when(_get(b, "$.type").isin("text", "input_text", "output_text"), _get(b, "$.text"))), lambda t: t.isNotNull())
    return F.when(blocks.isNotNull(), F.array_join(texts, "\n")).otherwise(_get(content, "$"))


def _first(v: Column, names: list[str], kind: str = "string") -> Column:
    return F.coalesce(*(_get(v, f"$.{n}", kind) for n in names))


def _body(r: Column) -> Column:
    return F.coalesce(*(_get(r, f"$.{n}", "variant") for n in ("payload", "message", "data")), r)


def _role(r: Column, kind: Column) -> Column:
    """user, assistant or system by the record's role or type; a message with another role is the assistant's."""
    named = F.lower(F.coalesce(_get(_body(r), "$.role"), _get(r, "$.role")))
    by_kind = F.when(kind.contains("user"), "user").when(kind.contains("assistant") | kind.contains("ai"), "assistant").when(kind == "system", "system")
    role = (
        F.when(named.isin("user", "human", "prompt"), "user").when(named.isin("assistant", "ai", "bot", "model"), "assistant")
        .when(named.isin("system", "developer"), "system").when(named.isNull(), by_kind)
    )
    return F.when((kind == "message") & _get(r, "$.payload.role").isNull() & (role != "user"), "assistant").otherwise(role)


def messages(lines: DataFrame) -> DataFrame:
    """session_id, line_number, role, content, ts, project_path of the messages in any of the formats."""
    r = F.col("record")
    kind = F.lower(F.coalesce(_first(r, ["type", "event", "kind"]), F.lit("")))
    body = _body(r)
    content = F.coalesce(*(_get(body, f"$.{n}", "variant") for n in ("content", "text", "output")), F.when(_get(body, "$").isNotNull(), body))
    of_codex = (kind != "response_item") | (_get(r, "$.payload.type") == "message")
    said = lines.filter(r.isNotNull() & F.coalesce(of_codex, F.lit(False)))
    cwd = F.coalesce(_first(r, ["cwd", "projectPath", "project_path", "workspacePath", "workspace"]), _get(r, "$.payload.cwd"))
    project = lines.filter(cwd.isNotNull()).groupBy("session_id").agg(F.min_by(cwd, "line_number").alias("_project"))
    ts = F.try_to_timestamp(_first(r, ["timestamp", "createdAt", "created_at", "time"]))
    one = F.struct("session_id", "line_number", _role(r, kind).alias("role"), sanitised(block_text(content)).alias("content"), ts.alias("ts"), "path", detect_format(F.col("path"), F.col("line")).alias("_format"))
    found = said.select(F.explode(F.array(one)).alias("m")).select("m.*")  # what follows doesn't compute a record's parts again
    kept = found.filter(F.col("role").isNotNull() & (F.col("content") != "")).join(project, "session_id", "left")
    named = F.coalesce("_project", F.when(F.col("_format") == "workbuddy", project_of_folder(F.col("path"))))
    return kept.select("session_id", "line_number", "role", "content", "ts", named.alias("project_path"))


def _json(v: Column) -> Column:
    """A value as the JSON of an object: text that holds JSON is parsed, what isn't an object stands as {"raw": ...}."""
    text = _get(v, "$")
    held = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(text)).otherwise(v)
    whole = F.to_json(held)
    return F.when(whole.startswith("{"), whole).when(v.isNotNull(), F.to_json(F.struct(text.alias("raw"))))


def tool_calls(lines: DataFrame) -> DataFrame:
    """session_id, line_number, tool_name, input (JSON of an object), ts, of calls that are records or blocks of a message."""
    r = F.col("record")
    body = _body(r)
    kind = F.lower(F.coalesce(_get(r, "$.payload.type"), _first(r, ["type", "event", "kind"]), F.lit("")))
    ts = F.try_to_timestamp(_first(r, ["timestamp", "createdAt", "created_at", "time"]))
    name = F.coalesce(_first(body, ["tool_name", "toolName", "name"]), _get(body, "$.tool.name"), _first(r, ["tool_name", "toolName", "name"]))
    given = F.coalesce(*(_get(body, f"$.{n}", "variant") for n in ("input", "arguments", "args")), _get(body, "$.tool.input", "variant"), *(_get(r, f"$.{n}", "variant") for n in ("input", "arguments")))
    calls = kind.isin("function_call", "tool_use") | kind.contains("tool_call") | kind.contains("tool-use")
    flat = lines.filter(calls & name.isNotNull()).select("session_id", "line_number", name.alias("tool_name"), F.coalesce(_json(given), F.lit("{}")).alias("input"), ts.alias("ts"))
    content = F.coalesce(_get(r, "$.message.content", "array<variant>"), _get(r, "$.content", "array<variant>"))
    blocks = lines.select("session_id", "line_number", ts.alias("ts"), F.explode(content).alias("b")).filter(_get(F.col("b"), "$.type") == "tool_use")
    nested = blocks.select("session_id", "line_number", F.coalesce(_get(F.col("b"), "$.name"), F.lit("unknown")).alias("tool_name"), F.coalesce(_json(_get(F.col("b"), "$.input", "variant")), F.lit("{}")).alias("input"), "ts")
    return flat.unionByName(nested)


def tool_outputs(lines: DataFrame) -> DataFrame:
    """What calls returned: session_id, call_id (line_N without one), content, line_number."""
    r = F.col("record")
    body = _body(r)
    kind = F.lower(F.coalesce(_get(r, "$.payload.type"), _first(r, ["type", "event", "kind"]), F.lit("")))
    gave = (kind == "function_call_output") | kind.rlike("tool[_-]result") | kind.contains("tool_output")
    call = F.coalesce(_get(body, "$.call_id"), _first(r, ["call_id", "callId"]), F.concat(F.lit("line_"), F.col("line_number").cast("string")))
    content = F.coalesce(*(_get(body, f"$.{n}", "variant") for n in ("content", "output")), _get(r, "$.result", "variant"))
    return lines.filter(gave).select("session_id", call.alias("call_id"), F.coalesce(block_text(content), F.to_json(content)).alias("content"), "line_number")


def changed_sessions(files: DataFrame, analysed: DataFrame) -> DataFrame:
    """Sessions (session_id, content_hash) that are new or have another hash than when they were analysed."""
    return files.join(analysed, ["session_id", "content_hash"], "left_anti")


def resumed(messages: DataFrame, progress: DataFrame) -> DataFrame:
    """Messages after the last line that each session was analysed to (session_id, last_line)."""
    return messages.join(progress, "session_id", "left").filter(F.col("line_number") > F.coalesce("last_line", F.lit(0))).drop("last_line")


def archived(messages: DataFrame) -> DataFrame:
    """A row for each session, as an archive lists them: messages, user messages, first and last line, characters."""
    return messages.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"), F.sum(F.length("content")).alias("characters"),
    )
