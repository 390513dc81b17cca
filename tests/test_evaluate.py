"""Round folding, continuation budget, statistics, run ids, questions,
permutation and the tokenizer hook."""

import pytest
from pyspark.sql import functions as F

from thinkframe.functions import format_question
from thinkframe.operators import evaluate, stats
from thinkframe.sources import benchmarks, families

ROUNDS = "question_id long, repeat int, round int, text string, prompt_tokens long, output_tokens long, finish_reason string"


def test_fold_rounds_rules(spark):
    rows = [(1, 0, 0, "a", 5, 10, "length"), (1, 0, 1, "b", 99, 20, "length"), (1, 0, 2, "c", 99, 30, "stop"),
            (2, 0, 0, "x", 7, 4, "stop"), (2, 0, 1, "ghost", 7, 4, "stop"),
            (3, 0, 0, "p", 1, 1, "length"), (3, 0, 1, "q", 1, 1, "length"), (3, 0, 2, "too-many", 1, 1, "stop")]
    df = spark.createDataFrame(rows, ROUNDS)
    got = {r.question_id: r for r in evaluate.fold_rounds(df, 1).collect()}
    a = got[1]
    assert (a.text, a.initial_round_text, a.prompt_tokens, a.output_tokens) == ("ab", "a", 5, 30)
    assert (a.continuation_output_tokens, a.was_truncated, a.still_truncated) == (20, True, True)
    assert (got[2].text, got[2].was_truncated, got[2].still_truncated) == ("x", False, False)
    assert got[3].text == "pq" and got[3].still_truncated
    g2 = {r.question_id: r for r in evaluate.fold_rounds(df, 2).collect()}
    assert g2[1].text == "abc" and not g2[1].still_truncated and g2[1].was_truncated


def test_fold_rounds_rejects_faulty_keys(spark):
    for rows, fault in (([(1, 0, 1, "b", 9, 2, "stop")], "round 0 is missing"),
                        ([(1, 0, 0, "a", 5, 1, "length"), (1, 0, 1, "b", 9, 2, "length"), (1, 0, 1, "b", 9, 2, "stop")], "occurs twice")):
        with pytest.raises(Exception, match=fault):
            evaluate.fold_rounds(spark.createDataFrame(rows, ROUNDS), 2).collect()


def test_generation_without_question_is_an_error(spark):
    folded = evaluate.fold_rounds(spark.createDataFrame([(1, 0, 0, "a", 5, 1, "stop")], ROUNDS), 1)
    qs = spark.createDataFrame([(2, "q", "7")], "question_id long, question string, reference string")
    with pytest.raises(Exception, match="no question for generation 1"):
        evaluate.grade_traces(folded, qs, "math500", "qwen3").collect()


def test_required_max_model_len_and_budget(spark):
    assert families.required_max_model_len("qwen3", 32768) == 4096 + 32768 + 4000
    assert families.required_max_model_len("qwen3", 32768, 2, 32768) == 40960
    assert families.required_max_model_len("dsr1_llama8b", 32768) == 4096 + 32768 * 3
    assert families.continuation_max_new_tokens_for("qwen3", 32768) == 4000
    assert families.continuation_max_new_tokens_for("dsr1_qwen7b", 1234) == 1234
    df = spark.createDataFrame([(0, 100), (1, 40000), (1, 10)], "r int, plen long")
    b = df.select(evaluate.round_budget(F.col("r"), F.col("plen"), F.lit(32768), F.lit(4000), F.lit(40960))).collect()
    assert [x[0] for x in b] == [32768, 960, 4000]


def test_family_constants():
    assert families.think_tags("qwen3") == ("<think>\n", "\n</think>\n\n")
    assert families.think_tags("gemma4") == ("<|channel>thought\n", "<channel|>")
    assert families.template("gemma4") == "gemma4"
    assert families.forced_assistant_prefix("dsr1_llama8b") == "<think>\n"
    assert families.forced_assistant_prefix("qwen3_4b") == ""
    assert families.needs_enable_thinking("qwen3_0p6b") and not families.needs_enable_thinking("dsr1_qwen7b")
    assert families.sampling_params_for("qwen3") == {"temperature": 0.6, "top_p": 0.95, "top_k": 20, "min_p": 0.0}
    assert families.max_continuation_rounds_for("dsr1_llama8b") == 2
    with pytest.raises(ValueError):
        families.think_tags("llama3")


def test_effective_sampling_params(spark):
    df = spark.createDataFrame([("qwen3", 0.7, None), ("dsr1_llama8b", None, None)], "model_family string, t double, p double")
    df = df.join(families.eval_family_dim(spark), "model_family").orderBy(F.desc("model_family"))
    m = evaluate.effective_sampling_params(F.col("sampling_params"), F.col("t"), F.col("p"),
                                           seed=F.lit(12346))
    rows = [dict(r[0]) for r in df.select(m).collect()]
    assert rows[0] == {"temperature": 0.7, "top_p": 0.95, "top_k": 20.0, "min_p": 0.0, "seed": 12346.0}
    assert rows[1] == {"temperature": 0.6, "top_p": 0.95, "seed": 12346.0}


def test_run_metadata_check(spark):
    df = spark.createDataFrame([("base", None), ("base", "c"), ("cotgen", None), ("cotgen", "c")],
                               "mode string, checkpoint_dir string")
    errs = [r.metadata_error for r in evaluate.check_run_metadata(df).collect()]
    assert errs == [None, "base_with_checkpoint", "checkpoint_missing", None]
    with pytest.raises(Exception):
        evaluate.check_run_metadata(df, "strict").collect()


def _traces(spark):
    rows = []
    for rep in range(2):
        for q in range(4):
            rows.append(("d", "cotgen", "aime24", "run1", rep, q, q % 2 == 0, q == 1, q == 1 and rep == 1,
                         10, 100, 5 * q, (3 if q == 1 else None), 10.0))
    return spark.createDataFrame(rows, "dataset_name string, mode string, benchmark string, run_id string, "
                                       "repeat int, question_id int, is_correct boolean, was_truncated boolean, "
                                       "still_truncated boolean, prompt_tokens long, output_tokens long, "
                                       "reasoning_tokens long, reasoning_tokens_added long, elapsed_seconds double")


def test_repeat_stats_and_summary(spark):
    pr = stats.repeat_stats(_traces(spark))
    r = pr.orderBy("repeat").collect()
    assert r[0].accuracy == 0.5 and r[0].num_questions == 4 and r[0].num_extended == 1
    assert r[0].num_extended_correct + r[0].num_extended_incorrect == r[0].num_extended
    assert r[0].extended_accuracy == 0.0 and r[1].num_still_truncated == 1
    assert r[0].median_reasoning_tokens == 7.5 and r[0].mean_extended_reasoning_tokens_added == 3.0
    assert r[0].input_tokens_per_sec == 4.0 and r[0].queries_per_sec == 0.4
    s = stats.run_summary(pr, num_repeats=3).first()
    assert (s.num_repeats_completed, s.is_complete, s.accuracy_std) == (2, False, 0.0)
    assert [x.repeat for x in s.per_repeat] == [0, 1]
    one = stats.run_summary(pr.where("repeat = 0"), num_repeats=1).first()
    assert one.accuracy_std == 0.0 and one.is_complete
    run = stats.running_summary(pr, num_repeats=2).orderBy("repeat").collect()
    assert [x.num_repeats_completed for x in run] == [1, 2] and [x.is_complete for x in run] == [False, True]


def test_next_run_id(spark):
    files = [("d", "m", "b", "d_m_b_run1_summary.json"), ("d", "m", "b", "d_m_b_run10_summary.json"),
             ("d", "m", "b", "d_m_b_manual1_summary.json"), ("d", "m", "b", "d_m_b_summary.json"),
             ("e", "m", "b", "e_m_b_nb2_summary.json")]
    df = spark.createDataFrame(files, "dataset_name string, mode string, benchmark string, file_name string")
    got = {r.dataset_name: r.next_run_id for r in stats.next_run_id(df).collect()}
    assert got == {"d": "run11", "e": "run1"}


def test_format_question_and_first_n(spark):
    df = spark.createDataFrame([("aime24", "  What?\n", None), ("gpqa_diamond", " Q ", {"A": "a", "B": " b", "C": "c", "D": "d"})],
                               "b string, q string, ch map<string,string>")
    out = [r[0] for r in df.select(format_question(F.col("b"), F.col("q"), F.col("ch"))).collect()]
    assert out[0] == "What?\n\nPlease reason step by step, and put your final answer within \\boxed{}."
    assert out[1].startswith("Q\n\nA) a\nB)  b\nC) c\nD) d\n\nThink step by step")
    bad = spark.createDataFrame([("nope", "q")], "b string, q string")
    with pytest.raises(Exception, match="unknown benchmark"):
        bad.select(format_question(F.col("b"), F.col("q"))).collect()
    qs = spark.range(10).withColumnRenamed("id", "pos")
    assert evaluate.first_n_questions(qs, 3).count() == 3
    # Positions need not begin at 0 nor follow each other; ties go by id.
    gaps = spark.createDataFrame([("a", p, f"q{p}{k}") for p in (16, 10, 12) for k in "yx"] + [("b", 7, "z")], "benchmark string, pos int, id string")
    assert sorted(r.id for r in evaluate.first_n_questions(gaps, 3).collect()) == ["q10x", "q10y", "q12x", "z"]
    assert evaluate.first_n_questions(gaps, None).count() == 7


def test_choice_permutation(spark):
    raw = spark.range(50).select(F.col("id").alias("pos"), *[F.concat(F.lit(f"o{j}-"), F.col("id").cast("string")).alias(f"o{j}")
                                                            for j in range(4)])
    rows = benchmarks.permute_choices(raw).collect()
    assert all(sorted(r.choices.values()) == sorted(f"o{j}-{r.pos}" for j in range(4)) for r in rows)
    assert all(r.choices[r.reference] == f"o0-{r.pos}" for r in rows) and len({r.reference for r in rows}) == 4


def test_tokenizer_hook(spark, tmpdir_path):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers
    import os
    vocab = {"[UNK]": 0, "hello": 1, "world": 2, "<think>": 3}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = os.path.join(tmpdir_path, "tok.json")
    tok.save(path)
    from thinkframe.functions.tokens import token_count_udf, token_texts_udf
    df = spark.createDataFrame([("hello world  again",), ("",)], "t string")
    rows = df.select(token_count_udf(path)(F.col("t")).alias("n"), token_texts_udf(path)(F.col("t")).alias("p")).collect()
    assert rows[0].n == 3 and "".join(rows[0].p) == "hello world  again" and rows[1].n == 0
    from thinkframe.functions.staged import apply_think_mask
    from thinkframe.functions.tokens import encode_for_mask
    ex = spark.createDataFrame([("hello", "<think> hello world </think> hello")], "prompt string, response string")
    m = apply_think_mask(encode_for_mask(ex, "prompt", "response", path), "<think>", "</think>").first()
    assert m.labels[0] == -100 and -100 not in m.labels[1:] and len(m.labels) == len(m.token_texts)
    assert "".join(m.token_texts) == "hello<think> hello world </think> hello"
    kept = [t for t, l in zip(m.token_texts, m.masked_labels) if l != -100]
    assert "".join(kept).replace(" ", "") == "<think></think>hello" and m.mask_status == "masked"


def test_eval_summary_records(spark):
    pr = stats.repeat_stats(_traces(spark))
    s = stats.run_summary(pr, num_repeats=2)
    runs = spark.createDataFrame([("d", "cotgen", "aime24", "run1", "qwen3", "ck", 32768, None, None, "out")],
                                 "dataset_name string, mode string, benchmark string, run_id string, model_family string, "
                                 "checkpoint_dir string, max_new_tokens int, temperature double, max_continuation_rounds long, "
                                 "output_dir string")
    r = stats.eval_summary_records(s, runs).first()
    assert r.continuation_max_new_tokens == 4000 and r.max_continuation_rounds == 1
    assert dict(r.sampling_params) == {"temperature": 0.6, "top_p": 0.95, "top_k": 20.0, "min_p": 0.0}
    assert r.trace_file == "out/d_cotgen_aime24_run1_traces.jsonl" and r.is_complete
    runs2 = runs.withColumn("model_family", F.lit("dsr1_qwen7b")).withColumn("max_continuation_rounds", F.lit(5).cast("long"))
    r2 = stats.eval_summary_records(s, runs2).first()
    assert r2.continuation_max_new_tokens == 32768 and r2.max_continuation_rounds == 5


def test_with_train_family(spark):
    df = spark.createDataFrame([("gemma4", "t", "a"), ("qwen3", "t", "a")], "model_family string, thinking string, answer string")
    from thinkframe.functions import think_response
    r = families.with_train_family(df).select(
        "model_family", think_response(F.col("thinking"), F.col("answer"), F.col("think_open"), F.col("think_close")).alias("r"))
    got = {x.model_family: x.r for x in r.collect()}
    assert got == {"gemma4": "<|channel>thought\nt<channel|>a", "qwen3": "<think>\nt\n</think>\n\na"}
    bad = spark.createDataFrame([("llama3",)], "model_family string")
    with pytest.raises(Exception, match="Unsupported training model_family"):
        families.with_train_family(bad).collect()
