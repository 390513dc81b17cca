"""Structured Streaming jobs equal their batch counterparts."""

import os

import pytest
from pyspark.sql import functions as F

from thinkframe import streaming
from thinkframe.operators import evaluate, report, stats
from thinkframe.plans import queries as Q
from thinkframe.sources import fixtures
from thinkframe.session import scratch_path
from thinkframe.sources.summaries import SPARK_SUMMARIES, load_eval_summaries
from thinkframe.streaming import rows_too_late, stream_files
from thinkframe.streaming.memory import open_samples, read_bounded_peaks, read_current_peaks, start_bounded_memory_stream, start_memory_stream
from thinkframe.streaming.rounds import read_folded_rounds, read_open_questions, start_round_stream
from thinkframe.streaming.run_summary import read_current_summary, start_run_summary_stream

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_streams_equal_batch_in_small_batches(spark):
    """Files in any order, one a batch."""
    root = scratch_path(spark, "small")
    traces, samples = Q._traces_f4(spark, SF_SMALL), fixtures.memory_samples(spark, SF_SMALL)
    for name, df in (("t", traces), ("s", samples)):
        df.repartition(5, "run_id").write.parquet(f"{root}/{name}")
    start_run_summary_stream(stream_files(spark, root + "/t", traces.schema, 1), root + "/to", root + "/tc").awaitTermination()
    batch = stats.run_summary(stats.repeat_stats(traces))
    cols = [c for c in batch.columns if c != "per_repeat"]
    assert _rows(read_current_summary(spark, root + "/to"), cols) == _rows(batch, cols)
    start_memory_stream(stream_files(spark, root + "/s", samples.schema, 1), root + "/so", root + "/sc").awaitTermination()
    cols = ["run_id", "peak_gpu_memory_mib_total", "num_samples"]
    assert _rows(read_current_peaks(spark, root + "/so"), cols) == _rows(report.memory_peak(samples), cols)


def test_streams_over_empty_folders(spark):
    root = scratch_path(spark, "empty")
    traces, samples = Q._traces_f4(spark, SF_SMALL).limit(0), fixtures.memory_samples(spark, SF_SMALL).limit(0)
    for name, df in (("t", traces), ("s", samples)):
        df.write.parquet(f"{root}/{name}")
    start_run_summary_stream(stream_files(spark, root + "/t", traces.schema), root + "/to", root + "/tc").awaitTermination()
    start_memory_stream(stream_files(spark, root + "/s", samples.schema), root + "/so", root + "/sc").awaitTermination()
    assert read_current_summary(spark, root + "/to").count() == read_current_peaks(spark, root + "/so").count() == 0


def test_stream_run_summary_incremental_restart(spark):
    """Repeats land over time; a restarted query continues from its
    checkpoint and the published summary always covers the landed repeats."""
    traces = Q._traces_f4(spark, SF_SMALL)
    root = scratch_path(spark, "st1-restart")
    stage, out, ck = root + "/traces", root + "/out", root + "/ck"
    traces.where("repeat = 0").write.mode("append").partitionBy("repeat").parquet(stage)
    schema = spark.read.parquet(stage).schema
    start_run_summary_stream(stream_files(spark, stage, schema, 1), out, ck).awaitTermination()
    cols = ["dataset_name", "mode", "benchmark", "run_id", "num_repeats_completed", "is_complete", "accuracy_mean"]
    first = stats.run_summary(stats.repeat_stats(traces.where("repeat = 0")))
    assert _rows(read_current_summary(spark, out), cols) == _rows(first, cols)
    traces.where("repeat > 0").write.mode("append").partitionBy("repeat").parquet(stage)
    start_run_summary_stream(stream_files(spark, stage, schema, 1), out, ck).awaitTermination()     # restart, same checkpoint
    full = stats.run_summary(stats.repeat_stats(traces))
    got = read_current_summary(spark, out)
    assert _rows(got, cols) == _rows(full, cols)
    assert got.where(F.col("is_complete")).count() > 0 and got.where(~F.col("is_complete")).count() > 0


def test_stream_memory_peak_restart(spark):
    s = fixtures.memory_samples(spark, SF_SMALL)
    cut = s.agg(F.percentile_approx(F.col("sample_ts").cast("long"), 0.5)).first()[0]
    root = scratch_path(spark, "st2-restart")
    stage, out, ck = root + "/samples", root + "/out", root + "/ck"
    s.where(F.col("sample_ts").cast("long") < cut).write.parquet(stage + "/part=0")
    schema = spark.read.parquet(stage).drop("part").schema
    start_memory_stream(stream_files(spark, stage + "/*", schema, 1), out, ck, watermark="2 hours").awaitTermination()
    s.where(F.col("sample_ts").cast("long") >= cut).write.parquet(stage + "/part=1")
    start_memory_stream(stream_files(spark, stage + "/*", schema, 1), out, ck, watermark="2 hours").awaitTermination()
    cols = ["run_id", "peak_gpu_memory_mib_total", "num_samples"]
    assert _rows(read_current_peaks(spark, out), cols) == _rows(report.memory_peak(s), cols)


def test_stream_memory_peak_exact_times_and_late_rows(spark):
    """Samples seconds apart stay apart; a late reading and a late failed reading change what was published."""

    schema = "run_id string, gpu string, sample_ts timestamp, mem double"
    first = [("r", "g0", "2024-01-01 00:00:00", 10.0), ("r", "g0", "2024-01-01 00:00:02", 11.0), ("r", "g0", "2024-01-01 00:00:04", 12.0),
             ("q", "g0", "2024-01-01 00:00:00", 10.0), ("q", "g0", "2024-01-01 00:00:10", 7.0)]
    late = [("r", "g1", "2024-01-01 00:00:02", 5.0), ("q", "g1", "2024-01-01 00:00:00", None), ("q", "g0", "2024-01-01 00:00:20", 6.0)]
    root = scratch_path(spark, "st2-late")
    for i, rows in enumerate((first, late)):
        df = spark.createDataFrame(rows, "run_id string, gpu string, ts string, mem double").selectExpr(
            "run_id", "gpu", "cast(ts as timestamp) as sample_ts", "mem")
        df.write.parquet(f"{root}/samples/part={i}")
        start_memory_stream(stream_files(spark, root + "/samples/*", schema, 1), root + "/out", root + "/ck", watermark="1 hour").awaitTermination()
    all_rows = spark.read.parquet(root + "/samples").drop("part")
    cols = ["run_id", "peak_gpu_memory_mib_total", "num_samples"]
    got = _rows(read_current_peaks(spark, root + "/out"), cols)
    assert got == _rows(report.memory_peak(all_rows), cols) == [("q", 7.0, 2), ("r", 16.0, 3)]


def _write_parts(spark, df, column, folder, parts):
    """One folder a part, in order, each read as a batch of its own."""
    for p in parts:
        df.where(f"{column} = {p}").drop(column).coalesce(1).write.parquet(f"{folder}/part={p}")


def test_readers_cost_follows_keys_not_batches(spark):
    """Eleven batches, compacted every third: few folders are left, and nothing is lost or counted twice."""
    root = scratch_path(spark, "compact")
    samples = fixtures.memory_samples(spark, SF_SMALL)
    samples.repartition(11, "run_id", "sample_ts").write.parquet(root + "/in")
    start_memory_stream(stream_files(spark, root + "/in", samples.schema, 1), root + "/out", root + "/ck", compact_every=3).awaitTermination()
    cols = ["run_id", "peak_gpu_memory_mib_total", "num_samples"]
    assert _rows(read_current_peaks(spark, root + "/out"), cols) == _rows(report.memory_peak(samples), cols)
    assert len(os.listdir(root + "/out/snapshots")) == 2
    assert sorted(int(n) for n in os.listdir(root + "/out/batches")) == list(range(6, 11))
    # A batch that is retried after its compaction gives the same snapshot.
    before = _rows(read_current_peaks(spark, root + "/out"), cols)
    streaming.compact(spark, root + "/out", streaming.latest(("run_id", "sample_ts")), 8)
    assert _rows(read_current_peaks(spark, root + "/out"), cols) == before


def _summaries(spark, root):
    return sorted(str(r) for r in load_eval_summaries(spark, [root + "/summaries"], SPARK_SUMMARIES).drop("source_path").collect())


def test_summary_files_after_a_killed_batch(spark):
    """K5: every batch rewrites the runs it touches; a query that dies while it does and starts again leaves the same files."""
    traces = Q._traces_f4(spark, SF_SMALL)
    root = scratch_path(spark, "k5")
    _write_parts(spark, traces.withColumn("p", F.col("repeat")), "p", root + "/in", range(3))
    died = []

    def run(name, records=None):
        return start_run_summary_stream(stream_files(spark, root + "/in/*", traces.schema, 1), f"{root}/{name}/out", f"{root}/{name}/ck",
                                        summaries_dir=f"{root}/{name}/summaries", records=records, compact_every=2)

    def dies_once(summary):
        if len(died) < 2:
            died.append(1)
            if len(died) == 2:
                raise RuntimeError("executor lost")
        return summary
    run("whole").awaitTermination()
    with pytest.raises(Exception, match="executor lost"):
        run("killed", dies_once).awaitTermination()
    first = _summaries(spark, root + "/killed")
    run("killed").awaitTermination()
    want = stats.run_summary(stats.repeat_stats(traces))
    cols = [c for c in want.columns if c != "per_repeat"]
    got = load_eval_summaries(spark, [root + "/killed/summaries"], SPARK_SUMMARIES)
    assert _rows(got, cols) == _rows(want, cols)
    assert first and _summaries(spark, root + "/killed") == _summaries(spark, root + "/whole") != first
    assert all(r.num_repeats_completed == len(r.per_repeat) for r in got.collect())


BOUND = "run_id string, gpu string, sample_ts timestamp, mem double"


def _readings(spark, rows):
    return spark.createDataFrame(rows, "run_id string, gpu string, ts string, mem double").selectExpr(
        "run_id", "gpu", "cast('2024-01-01 00:' || ts as timestamp) as sample_ts", "mem")


def test_bounded_memory_stream_keeps_open_samples_only(spark):
    """Sixty samples of two GPUs, ten seconds a batch: the state never holds more than the delay's samples, and peaks equal the batch operator's."""
    rows = [(f"r{k % 2}", f"g{k % 3}", f"{k // 10:02d}:{k % 60:02d}", float(k % 37) if k % 11 else None) for k in range(60) for _ in range(2)]
    root = scratch_path(spark, "bounded")
    whole = _readings(spark, rows)
    for i in range(6):
        _readings(spark, rows[20 * i:20 * i + 20]).coalesce(1).write.parquet(f"{root}/in/part={i}")
        q = start_bounded_memory_stream(stream_files(spark, root + "/in/*", BOUND, 1), root + "/out", root + "/ck", "30 seconds", compact_every=2)
        q.awaitTermination()
        assert rows_too_late(q) == 0
        newest = _readings(spark, rows[:20 * i + 20]).agg(F.max("sample_ts")).first()[0]
        held = open_samples(spark, root + "/ck").collect()
        assert held and all((newest - r.sample_ts).total_seconds() <= 30 for r in held)
        cols = ["run_id", "peak_gpu_memory_mib_total", "num_samples"]
        assert _rows(read_bounded_peaks(spark, root + "/out", root + "/ck"), cols) == _rows(report.memory_peak(_readings(spark, rows[:20 * i + 20])), cols)
    assert _rows(read_bounded_peaks(spark, root + "/out", root + "/ck"), cols) == _rows(report.memory_peak(whole), cols)
    closed = sum(r.num_samples for r in read_bounded_peaks(spark, root + "/out").collect())
    assert 0 < closed < sum(r.num_samples for r in report.memory_peak(whole).collect())


def test_bounded_memory_stream_leaves_late_readings_out(spark):
    """A reading within the delay counts, one behind it does not, whether it failed or not, and is counted as late."""
    root = scratch_path(spark, "late")
    batches = [[("r", "g0", "00:00", 10.0), ("r", "g0", "00:20", 11.0), ("r", "g0", "00:50", 5.0)],
               [("r", "g1", "00:45", 1.0), ("r", "g1", "00:50", 4.0), ("r", "g1", "00:00", 90.0), ("r", "g1", "00:20", None)],
               [("r", "g0", "02:00", 3.0)]]
    late = []
    for i, rows in enumerate(batches):
        _readings(spark, rows).coalesce(1).write.parquet(f"{root}/in/part={i}")
        q = start_bounded_memory_stream(stream_files(spark, root + "/in/*", BOUND, 1), root + "/out", root + "/ck", "10 seconds")
        q.awaitTermination()
        late.append(rows_too_late(q))
    assert late == [0, 2, 0]
    assert [tuple(r) for r in read_bounded_peaks(spark, root + "/out").collect()] == [("r", 11.0, 4)]
    assert [tuple(r) for r in read_bounded_peaks(spark, root + "/out", root + "/ck").collect()] == [("r", 11.0, 5)]


def test_bounded_memory_stream_before_its_first_batch(spark):
    root = scratch_path(spark, "none")
    spark.createDataFrame([], BOUND).write.parquet(root + "/in")
    start_bounded_memory_stream(stream_files(spark, root + "/in", BOUND), root + "/out", root + "/ck", "1 hour").awaitTermination()
    assert read_bounded_peaks(spark, root + "/out", root + "/ck").count() == 0


ROUND = "repeat int, question_id long, round int, text string, prompt_tokens long, output_tokens long, finish_reason string"


def _round_batches(spark, root, batches, most=2):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROUND).coalesce(1).write.parquet(f"{root}/in/part={i}")
        start_round_stream(stream_files(spark, root + "/in/*", ROUND, 1), root + "/out", root + "/ck", most, compact_every=2).awaitTermination()
        yield {(r.repeat, r.question_id): r for r in read_folded_rounds(spark, root + "/out").collect()}


def test_round_stream_folds_as_rounds_arrive(spark):
    """In any order; a question closes when it stops or has had its rounds, and later rounds count for nothing."""
    root = scratch_path(spark, "rounds")
    batches = [[(0, 1, 0, "a", 5, 10, "length"), (0, 2, 0, "x", 6, 3, "stop"), (0, 3, 1, "late", 7, 1, "stop")],
               [(0, 1, 2, "c", 5, 12, "length"), (0, 3, 0, "early ", 7, 2, "length"), (0, 2, 1, "ignored", 6, 9, "stop")],
               [(0, 1, 1, None, 5, None, "length"), (0, 1, 3, "beyond", 5, 1, "stop"), (1, 1, 0, "n", None, 4, None)]]
    seen = list(_round_batches(spark, root, batches))
    assert {k: (r.text, r.last_round, r.is_closed) for k, r in seen[0].items()} == {(0, 1): ("a", 0, False), (0, 2): ("x", 0, True)}
    assert (seen[1][0, 1].text, seen[1][0, 3].text, seen[1][0, 2].text) == ("a", "early late", "x")
    assert [r.question_id for r in read_open_questions(spark, root + "/out").collect()] == []
    everything = spark.createDataFrame([r for b in batches for r in b], ROUND)
    want = evaluate.fold_rounds(everything, 2)
    assert _sorted(read_folded_rounds(spark, root + "/out").select(*want.columns)) == _sorted(want)
    assert seen[2][0, 1].still_truncated and seen[2][0, 1].is_closed and seen[2][0, 1].text == "ac"
    held = spark.read.format("statestore").load(root + "/ck").select("value.*").collect()
    assert held and all("early " not in str(r) for r in held)  # closed questions hold no text


def _sorted(df):
    return sorted(str(r) for r in df.collect())


def test_round_that_comes_twice_is_an_error(spark):
    for second in (0, 1):  # of an open and of a closed question
        root = scratch_path(spark, "twice")
        with pytest.raises(Exception, match="a round occurs twice"):
            list(_round_batches(spark, root, [[(0, 1, 0, "a", 5, 10, "length" if second else "stop"), (0, 1, 1, "b", 5, 10, "length")], [(0, 1, second, "b", 5, 1, "stop")]]))
