"""Task metrics, token lengths and tool conversations against plain Python."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import tasks

TOKEN = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:``|[^`])*`|<=|>=|<>|!=|=~|[A-Za-z_]\w*|\d+(?:\.\d+)?|[^\s]")


def tokens(text):
    found = TOKEN.findall(text)
    return found[:-1] if found[-1:] == [";"] else found


def f1(o, p, r):
    return 1.0 if p == r == 0 else 0.0 if o == 0 else 2 * (o / p) * (o / r) / (o / p + o / r)


def rouge(a, b, n):
    x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
    return f1(sum((x & y).values()), sum(x.values()), sum(y.values()))


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(row[-1], best[j + 1]))
        best = row
    return f1(best[-1], len(a), len(b))


QUERIES = ["MATCH (a:River)-[r]->(b) WHERE a.name = 'O\\'Hara  x' AND a.n >= 1.50 RETURN b;", "match (a) return a", "MATCH (é:Été) RETURN `odd ``name` <> 2", "", ";", "RETURN 'open", "MATCH\n(a)\tRETURN a.x != 3 ;;"]


def test_metrics_of_both_tasks(spark):
    r = random.Random(3)
    rows, right, exact, sums = [], 0, 0, [0.0, 0.0, 0.0]
    for i in range(60):
        if i % 3 == 0:
            ref, pred = r.choice(["YES", " NO "]), r.choice(["YES", '{"label": "NO"}', "maybe", None])
            right += {"YES": "YES", '{"label": "NO"}': "NO"}.get(pred) == ref.strip()
        else:
            ref, q = r.choice(QUERIES), r.choice(QUERIES)
            pred = r.choice([q, json.dumps({"cypher": q}), f"so:\n```cypher\n{q}\n```"]) if q.strip() else q
            a, b = tokens(q), tokens(ref)
            exact += a == b
            low = [[t.lower() for t in x] for x in (a, b)]
            for k, s in enumerate((rouge(*low, 1), rouge(*low, 2), lcs(*low))):
                sums[k] += s
        rows.append((i, pred, ref))
    got = tasks.task_metrics(spark.createDataFrame(rows, "id int, prediction string, reference string"), "id").first()
    assert (got.selector_count, got.generator_count) == (20, 40)
    assert (got.selector_accuracy, got.generator_exact_match) == (round(5 * right, 4), round(2.5 * exact, 4))
    assert [got.generator_rouge1, got.generator_rouge2, got.generator_rougeL] == [round(2.5 * s, 4) for s in sums]
    none = tasks.task_metrics(spark.createDataFrame([], "id int, prediction string, reference string"), "id").first()
    assert none.selector_count == none.generator_count == 0 and none.generator_rouge1 is None


def test_token_lengths_by_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    chats = [(1, [("user", "What flows?"), ("assistant", "Rivers <|endoftext|> do. é")]), (2, [("system", "s"), ("user", "word " * 3000), ("assistant", "")])]
    df = spark.createDataFrame(chats, "id int, messages array<struct<role:string,content:string>>")
    show = lambda ms: "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in ms)
    n = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    want = {i: (n(show(ms[:-1]) + "<|im_start|>assistant\n"), n(show(ms))) for i, ms in chats}
    got = tasks.token_lengths(df, "id", "qwen", path)
    assert {r.id: (r.prompt, r.total) for r in got.collect()} == want
    m = tasks.longest(got).first()
    assert (m.rows, m.max_prompt_tokens, m.max_total_tokens, m.max_response_tokens) == (2, max(p for p, _ in want.values()), max(x for _, x in want.values()), max(x - p for p, x in want.values()))
    with pytest.raises(Exception, match="a prompt and a response"):
        tasks.token_lengths(spark.createDataFrame([(1, [("user", "x")])], df.schema), "id", "qwen", path).collect()


KIND = "messages array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string>>>>"


@pytest.mark.parametrize(
    "messages, problem",
    [
        ([("user", "q", None), ("assistant", None, [("find", '{"a": 1, "b c": {"x": [2]}, "n": null}')]), ("observation", "r", None), ("function", "r", None)], None),
        ([("user", "q", None), ("assistant", "", [("find", "{}"), ("list", '{"a": "t"}')])], None),
        ([], "no_messages"), ([("robot", "q", None)], "unknown_role"), ([("user", None, None)], "no_content"), ([("user", "", [("f", "{}")])], "calls_beside_assistant"),
        ([("assistant", "text", [("f", "{}")])], "text_beside_calls"), ([("assistant", "", [])], "empty_calls"), ([("assistant", None, [("f", "[1]")])], "not_a_call"),
        ([("assistant", None, [("", "{}")])], "not_a_call"), ([("assistant", None, [("f", None)])], "not_a_call"), ([("assistant", None, [("f", '{"a": ')])], "not_a_call"),
    ],
)
def test_tool_conversations(spark, messages, problem):
    df = spark.createDataFrame([(messages,)], KIND)
    assert df.select(tasks.tool_problem(F.col("messages"))).first()[0] == problem
    if problem:
        with pytest.raises(Exception, match=problem):
            df.select(tasks.tool_messages(F.col("messages"))).collect()
        return
    got = df.select(tasks.tool_messages(F.col("messages")).alias("m")).first().m
    assert [m.role for m in got] == ["tool" if role in ("observation", "function") else role for role, *_ in messages]
    for m, (_, content, calls) in zip(got, messages):
        assert m.content == content and (m.tool_calls is None) == (calls is None)
        for c, (name, arguments) in zip(m.tool_calls or [], calls or []):
            want = json.loads(arguments)
            assert c.name == name and {k: v if v is None or isinstance(want[k], str) else json.loads(v) for k, v in c.arguments.items()} == want
