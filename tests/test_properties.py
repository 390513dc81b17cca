"""Property tests against brute-force definitions written from the stated
"""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from thinkframe import functions as tf
from thinkframe.functions import staged

ALPHABET = st.sampled_from(list("ab{}\\ x") + ["\\boxed{"])


def brute_last_boxed(text):
    start = text.rfind("\\boxed{")
    if start < 0:
        return None
    i = start + len("\\boxed{")
    depth = 1
    for j in range(i, len(text)):
        depth += {"{": 1, "}": -1}.get(text[j], 0)
        if depth == 0:
            return text[i:j]
    return None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=12))
def test_last_boxed_matches_brute_force(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tf.last_boxed(F.col("t"))).collect()]
    got_staged = [r.b for r in staged.with_last_boxed(df, "t", "b").collect()]
    want = [brute_last_boxed(t) for t in texts]
    assert got == want and got_staged == want


def brute_mask(tokens, n_prompt, op, cl):
    labels = [-100] * n_prompt + list(range(n_prompt, n_prompt + len(tokens)))
    text = "".join(tokens)
    o, c = text.find(op), text.rfind(cl)
    if o < 0 or c < 0 or c <= o:
        return labels

    def idx(target):
        total = 0
        for i, t in enumerate(tokens, start=1):
            total += len(t)
            if total >= target:
                return i
        return len(tokens)
    cs, ce = idx(o + len(op)), idx(c)
    for k in range(n_prompt + cs, n_prompt + ce):
        labels[k] = -100
    return labels


PIECES = st.sampled_from(["<t>", "</t>", "a", "bc", "", "<", "t>", "/t", "xyz"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(PIECES, min_size=1, max_size=10), min_size=1, max_size=8), st.integers(1, 3))
def test_mask_matches_brute_force(spark, token_lists, n_prompt):
    rows = [(["p"] * n_prompt + toks, [-100] * n_prompt + list(range(n_prompt, n_prompt + len(toks))))
            for toks in token_lists]
    df = spark.createDataFrame(rows, "token_texts array<string>, labels array<int>")
    got = [list(r.masked_labels) for r in staged.apply_think_mask(df, "<t>", "</t>").collect()]
    got_col = [list(r[0]) for r in df.select(tf.think_mask("token_texts", "labels", "<t>", "</t>")["labels"]).collect()]
    want = [brute_mask(toks, n_prompt, "<t>", "</t>") for toks in token_lists]
    assert got == want and got_col == want


def brute_split(prefix, text, op="<think>", cl="</think>"):
    full = prefix + text
    for i in range(len(full)):
        if full.startswith(op, i):
            j = full.find(cl, i + len(op))
            if j >= 0:
                return full[i + len(op):j].strip(), full[j + len(cl):].strip()
    return "", full.strip()


SPLIT_PIECES = st.sampled_from(["<think>", "</think>", "a", " ", "\n", "<", "think>", "</", "　", "b"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(SPLIT_PIECES, max_size=10).map("".join), min_size=1, max_size=10),
       st.sampled_from(["", "<think>\n"]))
def test_split_matches_brute_force(spark, texts, prefix):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.s.thinking, r.s.answer) for r in df.select(tf.split_think_answer(F.lit(prefix), F.col("t")).alias("s")).collect()]
    got_staged = [(r.thinking, r.answer) for r in staged.with_split_think_answer(df, prefix, "t").collect()]
    want = [brute_split(prefix, t) for t in texts]
    assert got == want and got_staged == want
