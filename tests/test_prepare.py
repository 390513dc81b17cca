"""Training-set construction: records, exact splits and the catalog."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thinkframe.functions import think_response
from thinkframe.operators import prepare
from thinkframe.sinks import commit_catalog, read_catalog, write_records
from thinkframe.sources import families
from thinkframe.sources.examples import check_required, load_examples

# Edge white space, an inner line break and two rows that are equal but for the prompt.
RAW = [dict(zip(("prompt", "thinking", "answer"), row)) for row in (
    ("Which gate closes last?", "\tthe north gate\nthen the south one", " south \n"),
    ("Name a colour of row 11", "row 11 is teal", "teal"),
    ("Name the colour of row 11", "row 11 is teal", "teal"),
    ("Count the owls", "seven on the roof, one below", "8"))]


def _raw_df(spark):
    return spark.createDataFrame([(str(i), r["prompt"], r["thinking"], r["answer"]) for i, r in enumerate(RAW)],
                                 "ex_id string, prompt string, thinking string, answer string")


def test_think_response_both_families(spark):
    df = spark.createDataFrame([("reasoning here", "42")], "t string, a string")
    o, c = families.think_tags("qwen3")
    assert df.select(think_response(F.col("t"), F.col("a"), o, c)).first()[0] == "<think>\nreasoning here\n</think>\n\n42"
    o, c = families.think_tags("gemma4")
    r = df.select(think_response(F.col("t"), F.col("a"), o, c)).first()[0]
    assert r == "<|channel>thought\nreasoning here<channel|>42"
    assert "\n<channel|>" not in r


def test_build_cot_data_modes_identical_and_keys(spark):
    out = prepare.build_cot_data(_raw_df(spark), "task_qwen3", "qwen3", val_fraction=0.25, seed=1)
    keys = {r.dataset_key for r in out.select("dataset_key").distinct().collect()}
    assert keys == {"task_qwen3_cotgen_train", "task_qwen3_cotgen_val",
                    "task_qwen3_cotcond_train", "task_qwen3_cotcond_val"}
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault((r.mode, r.split), []).append((r.ex_id, r.system, tuple(tuple(x) for x in r.conversations)))
    assert sorted(by[("cotgen", "train")]) == sorted(by[("cotcond", "train")])
    assert len(by[("cotgen", "val")]) == 1 and len(by[("cotgen", "train")]) == 3
    conv = rows[0].conversations
    assert conv[0]["from"] == "human" and conv[1]["from"] == "gpt" and "<think>" in conv[1]["value"]


def test_unsupported_family_raises(spark):
    with pytest.raises(ValueError):
        prepare.build_cot_data(_raw_df(spark), "task_x", "llama3")


def test_explicit_val_input_bypasses_split(spark):
    df = _raw_df(spark)
    out = prepare.build_cot_data(df, "t", "qwen3", val_raw=df.limit(1))
    assert out.where("split = 'val'").count() == 2 and out.where("split = 'train'").count() == 8


@pytest.mark.parametrize("n,frac", [(1, 0.02), (50, 0.02), (997, 0.1), (3000, 0.5)])
def test_holdout_exact_disjoint_complete(spark, monkeypatch, n, frac):
    monkeypatch.setattr(prepare, "BUCKET_DIGITS", 1)
    df = spark.range(n).withColumnRenamed("id", "ex_id")
    s = prepare.holdout_split(df, frac, seed=7).collect()
    val = sorted(r.ex_id for r in s if r.split == "val")
    assert len(s) == n and len(val) == max(1, int(n * frac))
    import hashlib
    expect = sorted(range(n), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))[:len(val)]
    assert val == sorted(expect)


def test_holdout_zero_fraction(spark):
    df = spark.range(5).withColumnRenamed("id", "ex_id")
    assert prepare.holdout_split(df, 0.0).where("split = 'val'").count() == 0


def test_required_fields(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps(RAW[0]) + "\n\n")
        f.write(json.dumps({"prompt": "x", "thinking": None, "answer": ""}) + "\n")
        f.write(json.dumps({"prompt": "y", "answer": "z"}) + "\n")
    df = load_examples(spark, p)
    good, bad = check_required(df, "quarantine")
    assert good.count() == 1
    assert sorted(r.missing_fields[0] for r in bad.collect()) == ["thinking", "thinking"]
    with pytest.raises(Exception, match="missing required field"):
        check_required(df, "strict").collect()
    arr = os.path.join(tmpdir_path, "raw.json")
    with open(arr, "w") as f:
        json.dump(RAW, f)
    assert load_examples(spark, arr).count() == 4


def test_catalog_upsert_and_sinks(spark, tmpdir_path):
    recs = prepare.build_cot_data(_raw_df(spark), "task_qwen3", "qwen3", val_fraction=0.25, seed=1)
    write_records(recs, os.path.join(tmpdir_path, "data"))
    back = spark.read.json(os.path.join(tmpdir_path, "data"))
    assert back.count() == 8 and set(back.columns) >= {"system", "conversations", "dataset_key"}
    old = spark.createDataFrame([("other_task", "x.json", "sharegpt", {}, {}, 3),
                                 ("task_qwen3_cotgen_train", "old.json", "sharegpt", {}, {}, 9)],
                                T.StructType(prepare.CATALOG_SCHEMA.fields + [T.StructField("num_rows", T.LongType())]))
    new = prepare.catalog_entries(recs, "data")
    cat = os.path.join(tmpdir_path, "catalog")
    commit_catalog(spark, cat, old)
    commit_catalog(spark, cat, new)
    rows = {r.dataset_key: r for r in read_catalog(spark, cat).collect()}
    assert len(rows) == 5 and rows["other_task"].file_name == "x.json"
    assert rows["task_qwen3_cotgen_train"].file_name == "data/dataset_key=task_qwen3_cotgen_train"
    assert rows["task_qwen3_cotgen_train"].formatting == "sharegpt"
    assert rows["task_qwen3_cotgen_train"].tags["assistant_tag"] == "gpt"


def test_trace_and_summary_sinks(spark, tmpdir_path):
    from thinkframe.sinks import write_run_summaries, write_traces
    tr = spark.createDataFrame([(0, "aime24", 1, True), (1, "gpqa_diamond", 2, False)],
                               "repeat int, benchmark string, question_id int, is_correct boolean")
    p = os.path.join(tmpdir_path, "traces")
    write_traces(tr, p)
    write_traces(tr, p)
    assert spark.read.json(p).count() == 4
    assert spark.read.json(p).where("benchmark = 'aime24'").count() == 2
    s = spark.createDataFrame([("d", "cotgen", "aime24", "run1", 0.5), ("d", "cotgen", "aime24", "run2", 0.7)],
                              "dataset_name string, mode string, benchmark string, run_id string, accuracy_mean double")
    sp = os.path.join(tmpdir_path, "summaries")
    write_run_summaries(s, sp)
    write_run_summaries(s.where("run_id = 'run2'").withColumn("accuracy_mean", F.lit(0.9)), sp)
    got = {r.run_id: r.accuracy_mean for r in spark.read.json(sp).collect()}
    assert got == {"run1": 0.5, "run2": 0.9}


def test_catalog_relative_paths():
    assert prepare.catalog_path("/data/lf/task", "/data/lf") == "task"
    assert prepare.catalog_path("/other/task", "/data/lf") == "/other/task"
    assert prepare.catalog_path("/data/lf/task/", None) == "/data/lf/task"


@pytest.mark.parametrize("n,frac,kinds", [(100, 0.5, 3), (301, 0.02, 1), (64, 0.3, 2)])
def test_holdout_exact_with_copies(spark, monkeypatch, n, frac, kinds):
    monkeypatch.setattr(prepare, "BUCKET_DIGITS", 1)
    df = spark.range(n).select(F.md5((F.col("id") % kinds).cast("string")).alias("ex_id"),
                               (F.col("id") % kinds).alias("kind")).repartition(5)
    s = prepare.holdout_split(df, frac, seed=3).collect()
    val = [r for r in s if r.split == "val"]
    assert len(s) == n and len(val) == max(1, int(n * frac))


def test_build_cot_data_identical_examples(spark):
    df = spark.createDataFrame([("p", "t", "a")] * 3, "prompt string, thinking string, answer string")
    df = df.withColumn("ex_id", F.md5(F.lit("same")))
    out = prepare.build_cot_data(df, "t_qwen3", "qwen3", val_fraction=0.25, seed=1)
    assert out.where("mode = 'cotgen' AND split = 'val'").count() == 1
    assert out.where("mode = 'cotgen' AND split = 'train'").count() == 2


@pytest.mark.parametrize("frac", [0.3, 0.5])
def test_holdout_copies_keep_their_size_when_written(spark, tmpdir_path, frac):
    """6,000 copies in uneven partitions with a wide text: the written split has the exact size."""
    df = spark.range(6000).select(F.md5(F.lit("copy")).alias("ex_id"), F.repeat(F.lit("wide "), 200).alias("text"),
                                  (F.col("id") % 4 * 0).alias("b")).repartition("b")
    path = tmpdir_path + "/split"
    prepare.holdout_split(df, frac).write.parquet(path)
    got = {r["split"]: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}
    assert got == {"val": int(6000 * frac), "train": 6000 - int(6000 * frac)}


def test_holdout_shuffles_no_rows(spark):
    """The cut is found over ids, and the split is a comparison: no exchange, window or sort of the examples."""
    df = spark.range(4000).select(F.col("id").alias("ex_id"), F.repeat(F.lit("text "), 20).alias("text"))
    plan = prepare.holdout_split(df, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_holdout_cut_among_rows_of_one_id(spark):
    """Rows that share an id go by content; the same rows are picked however they are laid out, and null ids come first."""
    df = spark.createDataFrame([(None if i % 2 else 5, f"t{i}") for i in range(40)], "ex_id int, text string")
    picks = [sorted(r.text for r in prepare.holdout_split(df.repartition(p), 0.3).where("split = 'val'").collect()) for p in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 12 and all(int(t[1:]) % 2 for t in picks[0])


def test_holdout_of_nothing_and_of_everything(spark):
    df = spark.range(9).withColumnRenamed("id", "ex_id")
    assert prepare.holdout_split(df.limit(0), 0.5).count() == 0
    assert {r.split for r in prepare.holdout_split(df, 1.0).collect()} == {"val"}
