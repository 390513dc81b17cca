"""The pipeline over a small folder: what each stage keeps, and edge cases of every stage."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from thinkframe.llm.mixing import mixed_rows, text_draw
from thinkframe.llm.staging import shared_path, staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int"


def make_docs(spark):
    en, de = "the house of the old man was near to the sea and ", "der alte mann und das haus an dem meer mit einem boot "
    rows = [(i, f"w{i} " + " ".join(f"{w}{(i * 31 + k * 7) % 97}" if k % 3 == 0 else w for k, w in enumerate((en if i % 2 else de).split() * 8)), "en" if i % 2 else "de", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[4][1], "de", "s1") for i in range(9)]  # copies
    rows += [(120, rows[7][1] + " extra", "en", "s2"), (130, None, "en", "s1"), (131, "", "en", "s1"), (132, "12 34", "en", "s1"), (133, rows[9][1] * 30, "en", None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], SCHEMA).repartition(3)


def test_stages_keep_what_they_should(spark):
    docs = make_docs(spark)
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, ""), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {n: {r.doc_id for r in d.collect()} for n, d in kept.items()}
    assert not ids["language_id"] & {130, 131, 132} and len(ids["language_id"]) == 71
    assert not ids["jaccard_join"] & {*range(100, 109), 120} and 4 in ids["jaccard_join"] and 7 in ids["jaccard_join"]
    assert ids["suffix_dedup"] == ids["jaccard_join"]
    assert all(r.n_chars == len(r.text) for r in kept["suffix_dedup"].collect())
    times = {}
    for r in kept["mixing"].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert re.search(r"\S", r.text)
    assert max(times.values()) <= 3
    pieces = kept["packing"].collect()
    assert sum(r.length for r in pieces if r.start == 0 and r.length == r.doc_tokens) > 0
    assert {r.doc_id for r in pieces} == set(times)


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, times long, copy string, `a.b` string, _d int, th long, row string, rank int, id string"


def make_hard(spark):
    """Repeated ids with other texts, null ids, copies, and columns named like the stages' own."""
    line = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(50))
    rows = [(1, line, "en"), (2, line, "en"), (2, other, "en"), (3, "one short text of its own here", "de"), (3, "another one that shares its id", "de"),
            (None, line, "en"), (None, "without an id", "en"), (4, None, "en"), (4, "a b c", None), (5, "a b c", "en"), (5, "a b c", "en"), (6, " ".join([*line.split()[:58], "x", "y"]), "en")]
    return spark.createDataFrame([(*r, "s", len(r[1] or ""), 7, "c", "dot", 1, 2, "r", 3, "i") for r in rows], CLASHES), rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_rows_that_share_an_id_are_told_apart(spark):
    docs, rows = make_hard(spark)
    got = pipeline.jaccard_join(spark, docs, "")
    assert got.columns == docs.columns
    # Brute force: the row of the smallest id of each group, one row of equal ones, and rows that belong to none.
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = {(r[0], r[1]) for r, s in zip(rows, sets) if r[0] is None or not s}
    for g in set(group):
        members = [(r[0], r[1]) for r, x, s in zip(rows, group, sets) if x == g and r[0] is not None and s]
        if members:
            least = min(m[0] for m in members)
            assert len({m for m in members if m[0] == least}) == 1
            want.add(next(m for m in members if m[0] == least))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_mixing_writes_each_row_as_often_as_it_is_taken(spark):
    docs, rows = make_hard(spark)
    got = pipeline.mixing(spark, docs, "")
    assert got.columns == docs.columns
    taken = {}
    for r in mixed_rows(docs.withColumn("twin", F.lit(1))).collect():
        if r.size:
            taken[r.doc_id, r.draw] = taken.get((r.doc_id, r.draw), 0) + r.taken // r.size
    counts = {}
    for r in got.select("doc_id", text_draw(F.col("text")).alias("draw")).collect():
        counts[r.doc_id, r.draw] = counts.get((r.doc_id, r.draw), 0) + 1
    assert counts == {k: n for k, n in taken.items() if n}


def test_every_stage_takes_any_columns(spark):
    docs, _ = make_hard(spark)
    for name, stage in pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, ""), name)
        assert name == "packing" or docs.columns == before.columns
    assert docs.count() > 0


def test_without_languages_lettered_texts_stay(spark):
    docs, rows = make_hard(spark)
    kept = pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert kept.count() == sum(bool(r[1]) for r in rows)


def test_empty_table_goes_through(spark):
    docs = make_docs(spark).limit(0)
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is pipeline.run and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if re.match(r"op\d+_", q)}
    folder = shared_path(spark, "tables")
    make_docs(spark).write.parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() > 0
