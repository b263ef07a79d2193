"""Scores of generated answers by task, token lengths of rendered chats, and tool calls in conversations."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.cypher import answer_udf
from ..functions.prompts import render_chat
from .conversations import selector_label

# Fixed value: the tokens of a query: texts and quoted names, operators of two signs, names, numbers, and any other sign alone.
QUERY_TOKEN = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:``|[^`])*`|<=|>=|<>|!=|=~|[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+(?:\.\p{Nd}+)?|[^\s\x{85}\x{A0}\x{2028}\x{2029}]"""


def query_tokens(text: Column) -> Column:
    """Tokens of a query, without one closing semicolon."""
    tokens = F.regexp_extract_all(text, F.lit(f"(?s){QUERY_TOKEN}"), F.lit(0))
    return scores.let(tokens, lambda t: F.when(F.element_at(F.concat(F.array(F.lit("")), t), -1) == ";", F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t))


def scored(rows: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, task, exact, rouge1, rouge2, rougeL) for each row. key tells rows apart; a null prediction or reference is empty.

    A reference that reads as a label makes a selector row, which is right if the prediction reads as the same label, and has no overlap scores. Other
    rows compare the tokens of the queries in both answers: exactly as they are, and in lower case by overlap.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = rows.select(key, selector_label(text(reference)).alias("label"), selector_label(text(prediction)).alias("said"), text(prediction).alias("p"), text(reference).alias("r"))
    selector = said.where("label is not null").select(key, F.lit("selector").alias("task"), F.coalesce(F.col("said") == F.col("label"), F.lit(False)).alias("exact"), *[F.lit(None).cast("double").alias(c) for c in ("rouge1", "rouge2", "rougeL")])
    tokens = said.where("label is null").select(key, query_tokens(answer_udf("p")).alias("p"), query_tokens(answer_udf("r")).alias("r"))
    low = lambda c: F.transform(c, F.lower)
    lowered = tokens.select(key, (F.col("p") == F.col("r")).alias("exact"), low("p").alias("p"), low("r").alias("r"))
    by_n = [scores.ngram_scores(lowered, key, "p", "r", n).withColumnRenamed("score", f"rouge{n}") for n in (1, 2)]
    generator = lowered.select(key, F.lit("generator").alias("task"), "exact", scores.rouge_l(F.col("p"), F.col("r")).alias("rougeL")).join(by_n[0], key).join(by_n[1], key)
    return selector.unionByName(generator)


def task_metrics(rows: DataFrame, key: str) -> DataFrame:
    """One row with the counts of both tasks, the selector's accuracy, and the generator's exact matches and overlap scores, in per cent of 4 places; null where a task has no rows."""
    s = scored(rows, key)
    share = lambda task, c: F.round(100 * F.avg(F.when(F.col("task") == task, F.col(c).cast("double"))), 4)
    return s.agg(
        F.count_if(F.col("task") == "selector").alias("selector_count"), F.count_if(F.col("task") == "generator").alias("generator_count"), share("selector", "exact").alias("selector_accuracy"), share("generator", "exact").alias("generator_exact_match"),
        *[share("generator", c).alias(f"generator_{c}") for c in ("rouge1", "rouge2", "rougeL")],
    )


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(path)
    read.encode_special_tokens = True
    return read


def token_counter(path: str):
    """A column function: how many tokens a text has by the tokenizer file at path, special strings as ordinary text. A worker reads the file once.

    Texts go through one by one: what a worker holds depends on the longest text, not on how many an Arrow batch would take.
    """

    @F.udf("int", useArrow=False)
    def count(text: str | None) -> int:
        return len(_tokenizer(path).encode(text or "", add_special_tokens=False))

    return count


def token_lengths(chats: DataFrame, key: str, family: str, tokenizer: str, bos: str = "") -> DataFrame:
    """(key, prompt, total) in tokens. chats: key, messages (role, content), whose last one is the response: the prompt is what stands before it and the opening of a reply. Chats of under two messages fail."""
    count = token_counter(tokenizer)
    long_enough = F.when(F.size("messages") >= 2, F.col("messages")).otherwise(F.raise_error(F.lit("a chat has a prompt and a response")))
    m = chats.select(key, long_enough.alias("messages"))
    before = F.slice("messages", F.lit(1), F.size("messages") - 1)
    shown = m.select(key, render_chat(before, family, bos).alias("prompt"), render_chat(F.col("messages"), family, bos, reply=False).alias("whole"))
    return shown.select(key, count("prompt").alias("prompt"), count("whole").alias("total"))


def longest(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, and the most tokens of a prompt, of a whole chat and of a response."""
    return lengths.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.max("prompt").alias("max_prompt_tokens"), F.max("total").alias("max_total_tokens"), F.max(F.col("total") - F.col("prompt")).alias("max_response_tokens"))


# Roles of messages, and those that give the result of a tool.
ROLES = ("system", "user", "assistant", "tool", "function", "observation")
RESULTS = ("function", "observation")


def tool_problem(messages: Column) -> Column:
    """The first rule that an array of (role, content, tool_calls array<struct<name, arguments>>) breaks, or null.

    Content may be null only beside tool calls; only assistants call tools, and then say nothing; a call has a name, and its arguments are a JSON object.
    """
    calls = lambda m: F.coalesce(F.size(m.tool_calls), F.lit(-1))
    any_of = lambda rule: F.exists(messages, rule)
    bad_call = lambda c: (F.coalesce(c["name"], F.lit("")) == "") | F.json_object_keys(c["arguments"]).isNull() | ~F.ltrim(c["arguments"]).startswith("{")
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "no_messages")
        .when(any_of(lambda m: m.role.isNull() | ~m.role.isin(*ROLES)), "unknown_role")
        .when(any_of(lambda m: m.content.isNull() & (calls(m) < 1)), "no_content")
        .when(any_of(lambda m: (calls(m) >= 0) & (m.role != "assistant")), "calls_beside_assistant")
        .when(any_of(lambda m: (calls(m) >= 0) & (F.coalesce(m.content, F.lit("")) != "")), "text_beside_calls")
        .when(any_of(lambda m: calls(m) == 0), "empty_calls")
        .when(any_of(lambda m: F.coalesce(F.exists(m.tool_calls, lambda c: F.coalesce(bad_call(c), F.lit(True))), F.lit(False))), "not_a_call")
    )


def tool_messages(messages: Column) -> Column:
    """Messages with results of tools under one role, and arguments as maps of text: nested values as their JSON, null as null. What breaks a rule of tool_problem() fails."""
    problem = tool_problem(messages)
    made = F.transform(
        messages,
        lambda m: F.struct(
            F.when(m.role.isin(*RESULTS), "tool").otherwise(m.role).alias("role"), m.content.alias("content"), F.transform(m.tool_calls, lambda c: F.struct(c["name"].alias("name"), F.from_json(c["arguments"], "map<string,string>").alias("arguments"))).alias("tool_calls")
        ),
    )
    return F.when(problem.isNull(), made).otherwise(F.raise_error(F.concat(F.lit("not a tool conversation: "), problem)))
