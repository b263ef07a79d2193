"""Structural rules of conversations and their conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles that a conversation may hold.
ROLES = ("system", "user", "assistant", "tool", "function", "observation")


def message_problems(messages: Column) -> Column:
    """Names of the rules that any message of an array of (role, content) breaks."""
    bad_role = F.exists(messages, lambda m: m.role.isNull() | ~m.role.isin(*ROLES))
    no_text = F.exists(messages, lambda m: F.coalesce(m.content, F.lit("")) == "")
    last = F.element_at(messages, -1).role
    return F.array_compact(
        F.array(
            F.when(F.size(messages) < 2, "too_short"),
            F.when(bad_role, "unknown_role"),
            F.when(no_text, "empty_content"),
            F.when((F.size(messages) > 0) & (last != "assistant"), "last_is_not_assistant"),
        )
    )


def gather(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation with its messages in order."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(ordered.alias("o")).select(conv, F.transform("o", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def tool_roles(messages: Column) -> Column:
    """Observations and function results as tool messages."""
    return F.transform(messages, lambda m: F.struct(F.when(m.role.isin("observation", "function"), "tool").otherwise(m.role).alias("role"), m.content.alias("content")))


def chat_row(system: Column, user: Column, response: Column) -> Column:
    """A prompt and its response as three messages."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", system), message("user", user), message("assistant", response))


def selector_label(text: Column) -> Column:
    """YES or NO from the bare word or from a JSON object with the one key ``label``; else null."""
    text = F.trim(text)
    only = F.json_object_keys(text) == F.array(F.lit("label"))
    value = F.get_json_object(text, "$.label")
    # A number or a boolean would read the same: the value must be a quoted string.
    quoted = F.regexp_like(text, F.lit(r'^\{\s*"label"\s*:\s*"'))
    return F.when(text.isin("YES", "NO"), text).when(only & quoted & value.isin("YES", "NO"), value)


def task_of(task: Column, response: Column) -> Column:
    """The given task, else selector if the response reads as a label, else generator."""
    return F.coalesce(task, F.when(selector_label(response).isNotNull(), "selector").otherwise("generator"))


def until_stop(tokens: Column, stops: list[int]) -> Column:
    """Tokens before the first stop token."""
    at = F.array_min(F.transform(F.array(*[F.lit(s) for s in stops]), lambda s: F.nullif(F.array_position(tokens, s), F.lit(0))))
    return F.slice(tokens, F.lit(1), F.coalesce(at.cast("int") - 1, F.size(tokens)))


def complete(fields: list[str]) -> Column:
    """Whether every field holds text other than blanks."""
    held = [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in fields]
    out = held[0]
    for x in held[1:]:
        out = out & x
    return out
