"""From raw documents to packed training sequences: five stages, each a distributed operator of ``thinkframe.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``docs``. ``run`` writes each
result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinkframe.llm.jaccard_join import row_components
from thinkframe.llm.language_id import UNDETERMINED, learn_languages, with_language
from thinkframe.llm.mixing import mixed_rows, text_draw
from thinkframe.llm.packing import pack_documents
from thinkframe.llm.ranks import spread_rank
from thinkframe.llm.staging import nfc, staged
from thinkframe.llm.suffix_dedup import without_repeats

#: A text whose best language has no greater share than this is rejected.
LEAST_SCORE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as a struct, beside its id and text: its own column names, whatever they are, meet no others."""
    return docs.select(F.struct(*[nfc(c) for c in docs.columns]).alias("row"), nfc("doc_id").alias("id"), nfc("text").alias("text"))


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts of no clear language.

    Rows are judged one by one, so repeated rows and ids, null ids and ties need no rule. If no row names a language, nothing
    can be learned and every lettered text stays. An empty table stays empty; all columns are kept.
    """
    trees = learn_languages(docs.select("text", "lang"))
    rows = with_language(docs, trees)
    if trees is None:
        return _columns(rows.where(F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))), docs)
    return _columns(rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > LEAST_SCORE)), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of those with the group's smallest id the one whose text hashes least.

    Rows are told apart by id and text, so a row that is no copy stays also if it shares its id with one; rows equal in id and text are
    one document and stay once. A row with a null id and a text without words stay. An empty table stays empty; all columns are kept.
    """
    groups = staged(row_components(docs).where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("doc_id", "th", "group"), "pipeline-groups")
    first = groups.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("f.*")
    copies = groups.join(first, ["doc_id", "th"], "left_anti")
    rows = _rows(docs).withColumn("th", F.xxhash64("text"))
    kept = rows.join(copies.select(F.col("doc_id").alias("id"), "th"), ["id", "th"], "left_anti")
    return _columns(kept.dropDuplicates(["id", "text"]), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that start earlier out of the texts; ``n_chars`` follows the text.

    Null texts stay null, no row goes; rows equal in id and text are one text and get equal results; null ids come
    before all others. An empty table stays empty; all columns are kept.
    """
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes each row as often as the mix takes it, up to three times; untaken and wordless ones go.

    Rows are told apart by id and text (a null id is an id); rows equal in both are taken together, and the first of them, in order of their
    columns, are written once more where the mix's takes do not divide among them. An empty table stays empty; all columns are kept.
    """
    taken = mixed_rows(docs).where("size > 0").groupBy(F.col("doc_id").alias("id"), "draw").agg(
        F.sum(F.col("taken") / F.col("size")).cast("long").alias("times"), F.count(F.lit(1)).alias("equal")).where("times > 0")
    taken = staged(taken, "pipeline-taken")
    rows = _rows(docs).withColumn("draw", text_draw(F.col("text"))).alias("r")
    key = F.col("r.id").eqNullSafe(F.col("t.id")) & (F.col("r.draw") == F.col("t.draw"))
    each, more = F.floor(F.col("times") / F.col("equal")), F.col("times") % F.col("equal")
    joined = rows.join(taken.alias("t"), key).select("row", F.col("r.id").alias("id"), F.col("r.draw").alias("draw"), each.alias("each"), more.alias("more"))
    # Only among equal rows with a remainder does it matter which row is which.
    some = staged(joined.where("more > 0").select("*", F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("null"),
                                                  F.monotonically_increasing_id().alias("at")), "pipeline-equal")
    ranked = spread_rank(some, ["i", "null", "draw"], F.xxhash64("at"), [F.to_json("row"), F.col("at")], "rank")
    rounds = joined.where("more = 0").select("row", "each").unionByName(
        ranked.select("row", (F.col("each") + (F.col("rank") < F.col("more")).cast("int")).alias("each")))
    copies = rounds.where("each > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each"))))
    return _columns(copies, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 2048 ids, by id and then text (null ids first).

    Null and empty texts are the end id alone, repeated rows are packed as often as they are there, an empty table gives no piece, other columns go.
    """
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]

#: Byte context trees, components and dynamic programmes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result's rows are pieces of packed windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
