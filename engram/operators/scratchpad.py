"""A session's scratchpad as a fold over its log of operations, in the JVM.

log(session_id, seq, op, key, value): op names a change of state, key is a tool or memory type, value the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.exprs import subtask_list

STATE = (
    "struct<goal:string,subtasks:array<string>,completed:array<string>,step:string,action:string,notes:string,summary:string,tool:string,"
    "outputs:array<struct<name:string,output:string>>,updates:array<string>,retrieved:array<string>,retries:int,error:string>"
)
# Keys that each section of the state takes; tool outputs take any.
SECTIONS = {"planning": ["current_goal", "subtasks", "completed_subtasks", "current_step", "next_action"], "execution": ["active_tool", "retry_count", "last_error"], "reflection": ["notes"]}


def _empty() -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit("").alias("goal"), none.alias("subtasks"), none.alias("completed"), F.lit("").alias("step"), F.lit("").alias("action"), F.lit("").alias("notes"), F.lit("").alias("summary"), F.lit("").alias("tool"),
        F.array().cast("array<struct<name:string,output:string>>").alias("outputs"), none.alias("updates"), none.alias("retrieved"), F.lit(0).alias("retries"), F.lit(None).cast("string").alias("error"),
    ).cast(STATE)


def _without_first(items: Column, value: Column) -> Column:
    at = F.array_position(items, value).cast("int")
    return F.concat(F.slice(items, F.lit(1), at - 1), F.slice(items, at + 1, F.size(items)))


def _with_output(outputs: Column, name: Column, output: Column) -> Column:
    """A tool's output in the place of its last one, or at the end."""
    entry = F.struct(name.alias("name"), output.alias("output"))
    return F.when(F.exists(outputs, lambda o: o["name"] == name), F.transform(outputs, lambda o: F.when(o["name"] == name, entry).otherwise(o))).otherwise(F.concat(outputs, F.array(entry)))


def _step(s: Column, e: Column) -> Column:
    op, key, value = e["op"], e["key"], e["value"]
    held = F.array_contains(s["subtasks"], value)
    changes = {
        "goal": {"set_goal": value},
        "subtasks": {"add_subtask": F.concat(s["subtasks"], F.array(value)), "set_subtasks": subtask_list(value), "complete_subtask": F.when(held, _without_first(s["subtasks"], value)).otherwise(s["subtasks"])},
        "completed": {"complete_subtask": F.when(held, F.concat(s["completed"], F.array(value))).otherwise(s["completed"]), "set_completed": subtask_list(value)},
        "step": {"set_step": value}, "action": {"set_action": value},
        "notes": {"add_note": F.concat(s["notes"], value, F.lit("\n")), "set_notes": value, "clear_notes": F.lit("")},
        "summary": {"add_summary": F.concat(s["summary"], value, F.lit("\n"))}, "tool": {"set_tool": value},
        "outputs": {"tool_output": _with_output(s["outputs"], key, value)},
        "updates": {"memory_update": F.concat(s["updates"], F.array(F.concat(key, F.lit("<update>:"), value))), "memory_insert": F.concat(s["updates"], F.array(F.concat(key, F.lit("<insert>:"), value))), "clear_updates": F.array().cast("array<string>")},
        "retrieved": {"add_retrieved": F.concat(s["retrieved"], F.array(value)), "clear_retrieved": F.array().cast("array<string>")},
        "retries": {"retry": s["retries"] + 1, "reset_retries": F.lit(0)},
        "error": {"set_error": value, "clear_error": F.lit(None).cast("string")},
    }

    def field(name: str, by_op: dict[str, Column]) -> Column:
        out = s[name]
        for o, new in by_op.items():
            out = F.when(op == o, new).otherwise(out)
        return out.alias(name)

    return F.when(op == "reset", _empty()).otherwise(F.struct(*(field(n, c) for n, c in changes.items())).cast(STATE))


def fold(log: DataFrame) -> DataFrame:
    """(session_id, state): the state after all operations of a session, in order of seq."""
    rows = log.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "key", "value"))).alias("ops"))
    return rows.select("session_id", F.aggregate("ops", _empty(), _step).alias("state"))


def valid_update(section: Column, key: Column) -> Column:
    ok = section == "tool_outputs"
    for name, keys in SECTIONS.items():
        ok = ok | ((section == name) & key.isin(keys))
    return F.coalesce(ok, F.lit(False))


def updates_as_log(updates: DataFrame) -> DataFrame:
    """updates(session_id, seq, section, key, value) that are valid, as operations of the log, each with the output that
    the update tool leaves; invalid ones are dropped (valid_update tells which)."""
    ops = {"current_goal": "set_goal", "subtasks": "set_subtasks", "completed_subtasks": "set_completed", "current_step": "set_step", "next_action": "set_action", "active_tool": "set_tool", "last_error": "set_error", "notes": "set_notes"}
    op = F.when(F.col("section") == "tool_outputs", "tool_output")
    for k, o in ops.items():
        op = op.when(F.col("key") == k, o)
    rows = updates.where(valid_update(F.col("section"), F.col("key"))).withColumn("op", op)
    said = F.concat(F.lit("Updated "), "section", F.lit("."), "key", F.lit(" = "), "value")
    own = rows.select("session_id", (F.col("seq") * 2).alias("seq"), "op", "key", "value")
    return own.unionByName(rows.select("session_id", (F.col("seq") * 2 + 1).alias("seq"), F.lit("tool_output").alias("op"), F.lit("update_scratchpad_state").alias("key"), said.alias("value")))


def output_of(state: Column, tool: str) -> Column:
    return F.get(F.filter(state["outputs"], lambda o: o["name"] == tool), F.lit(0))["output"]


def compiled(state: Column, title: str = "SHORT-TERM MEMORY") -> Column:
    """The scratchpad as prompt text under a title. A list of subtasks has no blank line behind it, an empty one has."""
    block = lambda head, body: F.concat(F.lit(head + ":\n"), body, F.lit("\n\n"))
    listed = lambda items, head, show: F.when(F.size(items) > 0, F.concat(F.lit(head + ":\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("  "), show(x), F.lit("\n"))), ""), F.lit("\n"))).otherwise(F.lit(head + ":\nNone\n\n"))
    tasks = F.when(F.size(state["subtasks"]) > 0, F.concat(F.lit("SUBTASKS:\n"), F.array_join(state["subtasks"], "\n"))).otherwise(F.lit("SUBTASKS:\nNone\n\n"))
    done = F.when(F.size(state["completed"]) > 0, F.concat(F.lit("\n\nCOMPLETED SUBTASKS:\n"), F.array_join(state["completed"], "\n"))).otherwise(F.lit("COMPLETED SUBTASKS:\nNone\n\n"))
    return F.concat(
        F.lit(title + "\n\n"), block("NOTES", state["notes"]), block("CONVERSATION SUMMARY", state["summary"]), block("CURRENT GOAL", state["goal"]), tasks, done,
        F.lit("\n\nCURRENT STEP:\n"), state["step"], F.lit("\n\n"), block("NEXT ACTION", state["action"]), block("ACTIVE TOOL", state["tool"]), listed(state["outputs"], "TOOL OUTPUTS", lambda o: F.concat(o["name"], F.lit(": "), o["output"])),
        listed(state["updates"], "MEMORY UPDATES", lambda u: u), block("RETRY COUNT", state["retries"].cast("string")), block("LAST ERROR", F.coalesce(F.nullif(state["error"], F.lit("")), F.lit("None"))),
    )
