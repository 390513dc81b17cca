"""Training-set construction: records (P4), seeded exact holdout (T1, J6),
mode fan-out (J4, E3) and the dataset catalog merge (K2)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (CATALOG_COLUMNS, CATALOG_FORMATTING, CATALOG_TAGS, DEFAULT_SEED,
                         DEFAULT_SYSTEM_PROMPT, DEFAULT_VAL_FRACTION, MODES)
from ..functions.formatting import conversation_record, dataset_key, think_response
from ..sources.families import think_tags

BUCKET_DIGITS = 4                  # hex digits that a level of the split's search counts: 65,536 buckets
COPY_CHUNK = 100_000               # equal rows that one task writes again


def build_examples(raw: DataFrame, system_prompt: str = DEFAULT_SYSTEM_PROMPT,
                   model_family: str = "qwen3") -> DataFrame:
    """Raw examples -> ShareGPT records (``system``, ``conversations``).
    The family's tags are resolved on the driver (unknown family raises)."""
    think_open, think_close = think_tags(model_family)
    gpt = think_response(F.col("thinking"), F.col("answer"), think_open, think_close)
    rec = conversation_record(F.col("prompt"), gpt, F.lit(system_prompt))
    others = [c for c in raw.columns if c not in ("prompt", "thinking", "answer")]
    return raw.select(*others, rec["system"].alias("system"), rec["conversations"].alias("conversations"))


def split_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _cut_of(hashes: DataFrame, keys: list[Column], n_val) -> tuple[str, int, int]:
    """Where the ``n_val(rows)`` smallest of the rows end, in order of the concatenated hex ``keys``: (prefix, wanted, there).

    All rows below ``prefix`` are wanted, and ``wanted`` of the ``there`` rows that begin with it; these numbers differ only if no key tells those rows
    apart. One count a level, over the next digits of the rows that share the prefix so far: a level brings at most
    16^BUCKET_DIGITS counts to the driver, and no row is sorted or ranked. A later key is computed only for rows equal in all before it.
    """
    prefix, wanted, done = "", None, 0
    for i, key in enumerate(keys):
        rows, inside = hashes, ""
        for j in range(i):
            rows = rows.where(keys[j] == prefix[32 * j:32 * j + 32])
        rows = rows.select(key.alias("_k"))
        while len(inside) < 32:
            here = rows.where(F.col("_k").startswith(inside)) if inside else rows
            digits = F.substring("_k", len(inside) + 1, BUCKET_DIGITS)
            counts = sorted((r.d, r.n) for r in here.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
            if wanted is None:
                wanted = n_val(sum(n for _, n in counts))
            for d, there in counts:
                if wanted <= there:
                    break
                wanted -= there
            else:
                return prefix, 0, 0  # an empty table
            inside, prefix = inside + d, prefix + d
            if wanted == there:
                return prefix, wanted, there
    return prefix, wanted, there


def holdout_split(df: DataFrame, val_fraction: float = DEFAULT_VAL_FRACTION, seed: int = DEFAULT_SEED,
                  id_col: str = "ex_id") -> DataFrame:
    """T1 + J6: add ``split`` = 'val' | 'train'.

    ``n_val = max(1, int(n * val_fraction))`` rows with the smallest
    ``md5('{seed}:{id}')`` (ties by content) form the validation set; the rest is
    train. ``val_fraction <= 0`` puts everything in train. Deterministic per
    seed, disjoint, complete and of exact size.
    (A seeded hash order, not Python's Mersenne shuffle: same contract,
    different picks.)

    The cut is found first, by radix refinement over the hashes (two or three small counting jobs that
    read the id alone); the split itself is then a comparison of each row's hash with the cut, without any shuffle. Only
    rows equal in every column, with the cut among them, take another way: they are counted and written again, in chunks,
    so a group of copies that straddles the cut is split exactly however large it is.
    """
    if val_fraction <= 0:
        return df.withColumn("split", F.lit("train"))
    cols = df.columns
    by_id = F.coalesce(split_hash(id_col, seed), F.lit("0" * 32))
    by_content = F.md5(F.to_json(F.struct(*cols)))
    prefix, wanted, there = _cut_of(df, [by_id, by_content], lambda n: max(1, int(n * val_fraction)))
    first, second = prefix[:32], prefix[32:]
    mine = F.substring(by_id, 1, len(first))
    in_val = mine <= first if not second else (mine < first) | ((mine == first) & (F.substring(by_content, 1, len(second)) <= second))
    split = df.withColumn("split", F.when(in_val, "val").otherwise("train"))
    if wanted == there:
        return split
    same = (by_id == first) & (by_content == second)
    one = df.where(same).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.array(*[F.struct(F.lit(name).alias("split"), F.lit(k).cast("long").alias("k")) for name, k in (("val", wanted), ("train", there - wanted))])
    size = F.least(F.lit(COPY_CHUNK), F.col("_s.k") - F.col("_from"))
    chunks = (one.withColumn("_s", F.explode(parts)).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s.k") - 1, F.lit(COPY_CHUNK))))
              .select(*cols, F.col("_s.split").alias("split"), size.alias("_k"), "_from"))
    again = chunks.repartition(F.col("_from"), F.col("split")).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    return split.where(~same).unionByName(again.select(*cols, "split"))


def fan_out_modes(df: DataFrame, modes=MODES) -> DataFrame:
    """Every row once per training mode (identical content)."""
    return df.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def build_cot_data(raw: DataFrame, dataset_name: str, model_family: str = "qwen3",
                   val_raw: DataFrame | None = None, val_fraction: float = DEFAULT_VAL_FRACTION,
                   system_prompt: str = DEFAULT_SYSTEM_PROMPT, seed: int = DEFAULT_SEED,
                   id_col: str = "ex_id") -> DataFrame:
    """P4 + T1 + J4 + E3 + P16: one DataFrame of records for all four
    outputs, keyed by ``dataset_key = {name}_{mode}_{split}``. An explicit
    validation input bypasses the holdout."""
    think_tags(model_family)   # unknown family -> ValueError before any work
    if val_raw is not None:
        split = raw.withColumn("split", F.lit("train")).unionByName(val_raw.withColumn("split", F.lit("val")))
    else:
        split = holdout_split(raw, val_fraction, seed, id_col)
    recs = build_examples(split, system_prompt, model_family)
    out = fan_out_modes(recs)
    return out.withColumn("dataset_key", dataset_key(F.lit(dataset_name), F.col("mode"), F.col("split")))


CATALOG_SCHEMA = T.StructType([
    T.StructField("dataset_key", T.StringType(), False),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("formatting", T.StringType(), True),
    T.StructField("columns", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), True),
])


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def catalog_path(base_path: str, catalog_dir: str | None) -> str:
    """Where entries point: ``base_path`` relative to ``catalog_dir`` when it
    lies inside it, else ``base_path`` unchanged."""
    if not catalog_dir:
        return base_path.rstrip("/")
    rel = os.path.relpath(base_path, catalog_dir)
    return base_path.rstrip("/") if rel == ".." or rel.startswith(".." + os.sep) else rel


def _entries(keys: DataFrame, base_path: str, catalog_dir: str | None) -> DataFrame:
    root = catalog_path(base_path, catalog_dir)
    return keys.select(
        "dataset_key",
        F.concat(F.lit(root + "/dataset_key="), F.col("dataset_key")).alias("file_name"),
        F.lit(CATALOG_FORMATTING).alias("formatting"),
        _map_lit(CATALOG_COLUMNS).alias("columns"), _map_lit(CATALOG_TAGS).alias("tags"), "num_rows")


def catalog_entries(records: DataFrame, base_path: str, catalog_dir: str | None = None) -> DataFrame:
    """One catalog entry per ``dataset_key`` found in ``records`` (K2 input),
    pointing at that key's output folder under ``base_path`` (made relative
    to ``catalog_dir`` when given and possible); the row count per key is
    computed with one partial aggregation."""
    return _entries(records.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("num_rows")), base_path, catalog_dir)


def counted_entries(spark: SparkSession, counts: dict[str, int], base_path: str, catalog_dir: str | None = None) -> DataFrame:
    """``catalog_entries`` of keys whose rows have been counted already."""
    return _entries(spark.createDataFrame(list(counts.items()), "dataset_key string, num_rows long"), base_path, catalog_dir)


def upsert_catalog(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K2: entries of ``new`` replace same-key entries of ``existing``; other
    existing keys are kept untouched."""
    kept = existing.join(new.select("dataset_key"), "dataset_key", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
