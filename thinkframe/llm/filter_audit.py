"""Operator 11: what each filter of a cleaning chain does in every order of the chain.

A document is reduced once to a mask (bit i: it fails filter i), and documents with
equal masks to a cell of counts, so the audit's cost does not depend on the corpus. A
recursive common table expression then enumerates the orders: every level
extends each prefix by each letter it does not use, joins the mask cells, and
carries the bits applied so far; a level's rows are the metrics of that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import nfc, staged

#: Filters in bit order.
LETTERS = "ABCDE"
_SPACES = " \t\n\x0b\f\r"
_COUNTS = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[tuple[str, Column]]:
    """(name, condition) of the four filters that read one text: few words (A), few different words (B), capitals (C), symbols (D).

    ``words`` holds the maximal runs outside space and the control characters 9 to 13; the conditions
    refer to it by name and to ``text``, which must not be null.
    """
    n_words = F.when(F.length(F.btrim(text, F.lit(_SPACES))) == 0, 0).otherwise(F.size("words")).cast("long")
    distinct = F.when(n_words == 0, 0).otherwise(F.size(F.array_distinct("words"))).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [("A", n_words < 100), ("B", 100 * distinct < 80 * n_words),
            ("C", 100 * capitals > 10 * F.length(text)), ("D", text.rlike(r"[#$%&*|]"))]


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, 1 << LETTERS.index(letter)).otherwise(0)


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, good, toxic, n): rows of ``docs`` counted by id, part, mask and labels.

    Null texts are empty and a null part is the empty string. A document fails E if the same text has a
    smaller id anywhere; a null id is smaller than none and has none smaller, and rows equal in id and text do not
    fail one another. It is good (toxic) if any row of ``labels`` with its id says so; null labels and ids say nothing.

    Texts meet by a 128-bit hash and their length. Of a text only the smallest id is looked for, so copies
    are reduced before they move, and documents find it by (id, text): a hot text is no hot key.
    """
    rows = docs.select(nfc(id_col).cast("long").alias("doc_id"), F.coalesce(nfc(part_col), F.lit("")).alias("part"), F.coalesce(nfc(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.split(F.btrim("text", F.lit(_SPACES)), r"[\x20\x09-\x0D]+"))
    mask = sum((_bit(fails, letter) for letter, fails in text_failures(F.col("text"))), F.lit(0))
    flags = rows.select("doc_id", "part", mask.alias("mask"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), "text").alias("h2"), F.length("text").alias("size"))
    flags = staged(flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("n")), "flags")
    text_key = ["h1", "h2", "size"]
    named, unnamed = flags.where("doc_id is not null"), flags.where("doc_id is null")
    first = named.groupBy(*text_key).agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (labels.select(nfc(id_col).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
             .where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    named = (named.join(first, ["doc_id", *text_key], "left").join(marks, "doc_id", "left")
             .select("doc_id", "part", (F.col("mask") + _bit(F.col("first").isNull(), "E")).alias("mask"),
                     F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n"))
    return named.unionByName(unnamed.select("doc_id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n"))


def mask_cells(masks: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): at most 2^filters rows a part."""
    return masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
                                             F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))


_WALK = """
WITH RECURSIVE walk (prefix, before, applied, bit, part, mask, n, n_good, n_toxic) AS (
  SELECT '', 0, 0, 0, part, mask, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT concat(prefix, next.letter), before, applied | next.bit, next.bit, part, mask, n, n_good, n_toxic FROM (
    SELECT w.prefix, w.applied AS before, w.applied, c.part, c.mask, c.n, c.n_good, c.n_toxic,
      explode(filter({letters}, l -> (l.bit & w.applied) = 0)) AS next
    FROM walk w JOIN {cells} c ON c.part = w.part AND c.mask = w.mask))
SELECT * FROM walk LIMIT ALL
"""


def enumerate_orders(spark: SparkSession, cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(prefix, before, applied, bit, part, mask, n, n_good, n_toxic): every prefix of every order joined to every cell.

    Level k of the recursion holds the prefixes of k letters; its rows say which bits were applied before and after its
    last letter. Rows grow with the factorial of the filters (325 prefixes for five) times the cells, never with documents.
    """
    options = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    return spark.sql(_WALK.replace("{letters}", f"array({options})"), cells=cells).where("prefix <> ''")


def order_metrics(spark: SparkSession, cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    What a step does depends only on the letters before it, so steps are computed once a prefix
    and looked up for each order that begins with it. An empty ``cells`` gives no row.
    """
    walk = enumerate_orders(spark, cells, letters)
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition, column="n"):
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    steps = staged(walk.groupBy("part", "prefix").agg(
        total(F.col("mask").bitwiseAND(F.col("applied")) == 0).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~earlier, "n_good").alias("good_lost"), total(fails & ~earlier, "n_toxic").alias("toxic_lost")), "steps")
    orders = steps.where(F.length("prefix") == len(letters)).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    rows = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).join(steps, ["part", "prefix"]).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    shares = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "letter"]).select("part", "filter_order", "step", *[c.split()[0] for c in _COUNTS.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The metrics of every order of the five filters over ``docs``, by part (see ``failure_masks`` and ``order_metrics``).

    Every row of ``docs`` counts, repeated ones too; an empty table gives an empty
    result, an empty ``labels`` no good or toxic document; other columns are ignored.
    """
    cells = staged(mask_cells(failure_masks(docs, labels, id_col, text_col, part_col)), "cells")
    return order_metrics(docs.sparkSession, cells)
