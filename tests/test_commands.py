"""Command-level flows end to end through files."""

import glob
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from thinkframe.operators import prepare
from thinkframe.plans import commands
from thinkframe.sinks import commit_catalog, files, read_catalog
from thinkframe.sinks.catalog import versions
from thinkframe.sources.examples import load_examples

# Edge white space, an inner line break and two rows that are equal but for the prompt.
RAW = [dict(zip(("prompt", "thinking", "answer"), row)) for row in (
    ("Which gate closes last?", "\tthe north gate\nthen the south one", " south \n"),
    ("Name a colour of row 11", "row 11 is teal", "teal"),
    ("Name the colour of row 11", "row 11 is teal", "teal"),
    ("Count the owls", "seven on the roof, one below", "8"))]


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(obj, f)


def test_build_data_both_families_and_catalog(spark, tmpdir_path):
    inp, cat, data = (os.path.join(tmpdir_path, n) for n in ("raw.json", "catalog", "data"))
    _write(inp, RAW)
    out = commands.build_data(spark, inp, data, "task_qwen3", cat, "qwen3", val_fraction=0.25, seed=1)
    assert {r.dataset_key for r in out.collect()} == {
        "task_qwen3_cotgen_train", "task_qwen3_cotgen_val", "task_qwen3_cotcond_train", "task_qwen3_cotcond_val"}
    out2 = commands.build_data(spark, inp, data, "task_gemma4", cat, "gemma4", val_fraction=0.25, seed=1)
    rows = {r.dataset_key: r for r in out2.collect()}
    assert len(rows) == 8 and rows["task_qwen3_cotgen_train"].formatting == "sharegpt"
    assert {k: r.num_rows for k, r in rows.items() if "cond" in k} == {
        "task_qwen3_cotcond_train": 3, "task_qwen3_cotcond_val": 1, "task_gemma4_cotcond_train": 3, "task_gemma4_cotcond_val": 1}
    assert rows["task_gemma4_cotcond_val"].file_name == "data/dataset_key=task_gemma4_cotcond_val"
    assert sorted(r.dataset_key for r in read_catalog(spark, cat).collect()) == sorted(rows)
    recs = spark.read.json(data)
    gen = sorted(json.dumps(r.asDict(True)) for r in recs.where("dataset_key = 'task_gemma4_cotgen_train'").drop("dataset_key").collect())
    cond = sorted(json.dumps(r.asDict(True)) for r in recs.where("dataset_key = 'task_gemma4_cotcond_train'").drop("dataset_key").collect())
    assert gen == cond and "<|channel>thought" in gen[0]


def test_build_without_validation_rows_leaves_no_old_ones(spark, tmpdir_path):
    inp, cat, data = (os.path.join(tmpdir_path, n) for n in ("raw.json", "catalog", "data"))
    _write(inp, RAW)
    commands.build_data(spark, inp, data, "t", cat, val_fraction=0.5)
    out = commands.build_data(spark, inp, data, "t", cat, val_fraction=0)
    assert {r.dataset_key: r.num_rows for r in out.collect()} == {"t_cotgen_train": 4, "t_cotgen_val": 0, "t_cotcond_train": 4, "t_cotcond_val": 0}
    assert os.listdir(os.path.join(data, "dataset_key=t_cotgen_val")) == []
    assert {(r.dataset_key, r.num_rows) for r in read_catalog(spark, cat, 1).collect()} >= {("t_cotgen_val", 2)}


def _entry(spark, key, rows=1):
    return prepare.counted_entries(spark, {key: rows}, "data")


def test_writers_at_once_lose_nothing(spark, tmpdir_path):
    cat = os.path.join(tmpdir_path, "catalog")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: commit_catalog(spark, cat, _entry(spark, f"k{i}", i)), range(8)))
    assert sorted(got) == list(range(1, 9)) == versions(spark, cat)
    assert {(r.dataset_key, r.num_rows) for r in read_catalog(spark, cat).collect()} == {(f"k{i}", i) for i in range(8)}
    # Each version holds the one before it and one entry more.
    seen = [{r.dataset_key for r in read_catalog(spark, cat, v).collect()} for v in range(1, 9)]
    assert all(a < b and len(b - a) == 1 for a, b in zip(seen, seen[1:]))
    assert not [n for n in os.listdir(os.path.join(cat, "versions")) if not n.endswith(".json") and not n.startswith(".")]


def test_lost_race_merges_again(spark, tmpdir_path, monkeypatch):
    from thinkframe.sinks import catalog as module
    cat, real, raced = os.path.join(tmpdir_path, "catalog"), module.publish_once, []

    def slow(spark, path, text):
        if not raced:
            raced.append(path)  # another writer is faster, once
            commit_catalog(spark, cat, _entry(spark, "other"))
        return real(spark, path, text)
    monkeypatch.setattr(module, "publish_once", slow)
    assert commit_catalog(spark, cat, _entry(spark, "mine")) == 2
    assert {r.dataset_key for r in read_catalog(spark, cat).collect()} == {"mine", "other"}


def test_plain_catalog_is_the_first_base(spark, tmpdir_path):
    cat = os.path.join(tmpdir_path, "catalog")
    assert read_catalog(spark, cat).count() == 0 and versions(spark, cat) == []
    _entry(spark, "old").write.json(cat)
    assert commit_catalog(spark, cat, _entry(spark, "new")) == 1
    assert {r.dataset_key for r in read_catalog(spark, cat).collect()} == {"old", "new"}
    with pytest.raises(ValueError, match="no version 7"):
        read_catalog(spark, cat, 7)


def test_published_file_is_never_replaced(spark, tmpdir_path):
    for name in ("linked", "renamed"):
        path = os.path.join(tmpdir_path, name, "a.json")
        if name == "renamed":  # the way of file systems without hard links
            jvm = spark.sparkContext._jvm
            os.makedirs(os.path.dirname(path))

            def put(text):
                with open(path + ".new", "w") as f:
                    f.write(text)
                return files._rename(spark, jvm.org.apache.hadoop.fs.Path("file:" + path + ".new"), jvm.org.apache.hadoop.fs.Path("file:" + path))
        else:
            def put(text):
                return files.publish_once(spark, path, text)
        assert put("one") and not put("two") and files.read_text(spark, path) == "one"


def test_parquet_examples(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.parquet")
    spark.createDataFrame([(r["prompt"], r["thinking"], r["answer"]) for r in RAW],
                          "prompt string, thinking string, answer string").write.parquet(p)
    df = load_examples(spark, p)
    assert df.count() == 4 and df.where(F.col("ex_id").isNull()).count() == 0


def test_summarize_and_tables(spark, tmpdir_path):
    td, ed = os.path.join(tmpdir_path, "results"), os.path.join(tmpdir_path, "eval_results")
    _write(os.path.join(td, "s1k11_all_qwen3_cotgen_summary.json"), {
        "dataset_name": "s1k11_all_qwen3", "mode": "cotgen", "status": "SUCCESS",
        "end_time": "2024-01-01T00:00:00Z",
        "train_results": {"total_flos": 99, "train_runtime": 10.0, "num_input_tokens_seen": 1000}})
    rates = {f"{k}_per_sec_mean": 2.0 ** i for i, k in enumerate(("output_tokens", "input_tokens", "queries"))}
    base = dict(rates, num_questions=18, num_repeats=3, num_repeats_completed=2, accuracy_mean=0.5, accuracy_std=0.25,
                mean_reasoning_tokens_mean=321.0)
    _write(os.path.join(ed, "a_summary.json"), dict(base, dataset_name="s1k11_all_qwen3", mode="cotgen", benchmark="aime24"))
    _write(os.path.join(ed, "b_summary.json"), dict(base, dataset_name="s1k11_all_dsr1_llama8b", mode="cotcond",
                                                    benchmark="aime25", run_id="run1"))
    flat = commands.summarize_training(spark, td, os.path.join(tmpdir_path, "cmp"))
    assert flat.count() == 1 and len(glob.glob(os.path.join(tmpdir_path, "cmp", "*.csv"))) == 1
    final, missing = commands.build_final_table(spark, td, [ed, os.path.join(tmpdir_path, "nope")],
                                                os.path.join(tmpdir_path, "final"))
    assert final.count() == 2 and missing == 1
    pv = commands.build_pivot_table(spark, [ed], ["qwen3", "dsr1_llama8b"], os.path.join(tmpdir_path, "pivot"),
                                    show=True)
    assert commands.default_dirs("/p") == ("/p/results", ["/p/eval_results", "/p/eval_results_notebook"])
    assert pv.count() == 16
    r = pv.where("model = 'qwen3' AND ablation = 'all' AND benchmark = 'aime24'").first()
    assert r.cotgen_acc == 0.5 and r.cotgen_progress == "2/3"


def test_evaluate_rounds(spark, tmpdir_path):
    run = ("d", "cotgen", "run1")
    rounds = spark.createDataFrame([
        (*run, 0, 1, 0, "<think>a b", 5, 10, "length"), (*run, 0, 1, 1, " c</think>\\boxed{7}", 0, 5, "stop"),
        (*run, 0, 2, 0, "<think>x</think>\\boxed{3}", 6, 8, "stop"),
        (*run, 1, 1, 0, "<think>a</think>\\boxed{8}", 5, 4, "stop"),
        (*run, 1, 2, 0, "<think>y</think>\\boxed{3}", 6, 4, "stop")],
        "dataset_name string, mode string, run_id string, repeat int, question_id long, round int, text string, "
        "prompt_tokens long, output_tokens long, finish_reason string")
    questions = spark.createDataFrame([(1, "7"), (2, "3")], "question_id long, reference string")
    runs = spark.createDataFrame([("d", "cotgen", "aime24", "run1", "qwen3", "ck", 32768, "out")],
                                 "dataset_name string, mode string, benchmark string, run_id string, model_family string, "
                                 "checkpoint_dir string, max_new_tokens int, output_dir string")
    elapsed = spark.createDataFrame([(*run, 0, 2.0), (*run, 1, 4.0)],
                                    "dataset_name string, mode string, run_id string, repeat int, elapsed_seconds double")
    traces, per_repeat, summary = commands.evaluate_rounds(rounds, questions, runs, "aime24", "qwen3", elapsed,
                                                           os.path.join(tmpdir_path, "eval"))
    t = {(r.repeat, r.question_id): r for r in traces.collect()}
    assert t[(0, 1)].is_correct and t[(0, 1)].was_truncated and t[(0, 1)].thinking == "a b c"
    assert t[(0, 1)].reasoning_tokens == 3 and t[(0, 1)].reasoning_tokens_added == 3
    assert not t[(1, 1)].is_correct
    s = summary.first()
    assert (s.num_repeats_completed, s.accuracy_mean, s.num_extended_total) == (2, 0.75, 1)
    assert s.continuation_max_new_tokens == 4000 and s.trace_file == "out/d_cotgen_aime24_run1_traces.jsonl"
    assert spark.read.json(os.path.join(tmpdir_path, "eval", "summaries")).count() == 1


def test_second_dataset_leaves_the_first_alone(spark, tmpdir_path):
    from thinkframe.sinks.writers import write_records

    rows = "dataset_key string, system string, conversations string"
    write_records(spark.createDataFrame([("task_b_x", "s", "c1"), ("task_b_y", "s", "c2")], rows), tmpdir_path)
    write_records(spark.createDataFrame([("task_x", "s", "c3")], rows), tmpdir_path)
    write_records(spark.createDataFrame([("task_b_y", "s", "c4")], rows), tmpdir_path)
    got = {(r.dataset_key, r.conversations) for r in spark.read.json(tmpdir_path).collect()}
    assert got == {("task_b_x", "c1"), ("task_b_y", "c4"), ("task_x", "c3")}


def test_malformed_summary_is_an_error(spark, tmpdir_path):
    import pytest
    from thinkframe.sources.summaries import load_eval_summaries

    assert load_eval_summaries(spark, "file:" + tmpdir_path + "/absent").count() == 0
    with open(tmpdir_path + "/run" + __import__("thinkframe.constants", fromlist=["x"]).SUMMARY_SUFFIX, "w") as f:
        f.write("{not json")
    with pytest.raises(Exception):
        load_eval_summaries(spark, tmpdir_path).collect()
