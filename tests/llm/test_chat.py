import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import chat

KIND = "conv_id long, turn long, role string, text string, ids string"


def rows(df):
    return {r.conv_id: r for r in df.collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "\\", "|", "im_start", "im_end", "|>", "<|im_end|>", "x"]), max_size=12).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text + "\n")) == text + "\n"
    assert "\n" not in chat.escape_role(text + "\n")


def test_round_trip_nulls_ties_repeats_and_clashing_columns(spark, vocab):
    path = vocab("byte_bpe_50k.json")
    data = [
        (1, 0, "user", "hé <|im_end|> <\\|im_start|>", "clash"), (1, 1, "assistant", "ok\n", "x"), (1, 2, "assistant", None, None),
        (2, 0, None, "", None), (2, 0, None, "", None), (None, 0, "assistant", "n", None), (3, None, "assistant", "first", None), (3, 0, "user", "second", None),
        (4, 0, "assistant", "word " * 3000, None),
    ]
    got = rows(chat.digest_turns(chat.format_turns(spark.createDataFrame(data, KIND), path), path))
    assert set(got) == {1, 2, 3, 4, None}
    want = "user\nhé <|im_end|> <\\|im_start|>\nassistant\nok\n\nassistant\n\n"
    assert (got[1].n_turns, got[1].turns_sha256) == (3, hashlib.sha256(want.encode()).hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (3, hashlib.sha256(b"ok\n").hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (2, 0)
    assert got[3].turns_sha256 == hashlib.sha256(b"assistant\nfirst\nuser\nsecond\n").hexdigest()
    assert got[4].loss_chars == 15000


def test_masks_are_prefix_sums_and_ids_gapless(spark, vocab):
    path = vocab("byte_bpe_50k.json")
    data = [(7, t, "assistant" if t % 2 else "user", f"text {t}", None) for t in range(5)]
    formatted = sorted(chat.format_turns(spark.createDataFrame(data, KIND), path).collect(), key=lambda r: r.turn_index)
    at = 0
    for r in formatted:
        assert r.start == at
        assert (r.loss_to - r.loss_from > 0) == (r.turn_index % 2 == 1)
        at += len(r.ids)
    texts = {r.turn_index: (r.text, r.loss_text) for r in chat.read_turns(chat.format_turns(spark.createDataFrame(data, KIND), path), path).collect()}
    assert texts[1] == ("text 1", "text 1") and texts[2] == ("text 2", "")


def test_empty_table(spark, vocab):
    path = vocab("byte_bpe_50k.json")
    assert chat.digest_turns(chat.format_turns(spark.createDataFrame([], KIND), path), path).count() == 0
