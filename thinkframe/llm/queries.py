"""Registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitpack import packed_digest
from .decontam import contamination
from .embeddings import embedding_links
from .filter_audit import filter_audit
from .host_rules import host_quality
from .jaccard_join import jaccard_components
from .language_id import identify_languages
from .lm_scoring import score_texts
from .merkle import merkle_manifest
from .mixing import mix_documents
from .packing import pack_documents
from .shards import shard_rows
from .suffix_dedup import substring_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels and a cosine of 0.98 or more."""
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents, sources weighing 5, 2, 1 in turn."""
    return mix_documents(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    return shard_rows(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    return identify_languages(_table(spark, sf_dir, "documents"), _fold(5) == 0)


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document and the verdict with its source's shrunk failure rate."""
    return host_quality(_table(spark, sf_dir, "documents"))


def op6_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written bit-packed in id order, and what the files hold of each document."""
    return packed_digest(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a unigram and a log-bilinear class model."""
    return score_texts(_table(spark, sf_dir, "documents"), _fold(7) == 2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in windows of at most 2048, cut by dynamic programming."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""
    return substring_digest(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at each step of each of their 120 orders, by language."""
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary Merkle trees by language over all documents, a proof for each, and which ones a tampered length gives away."""
    return merkle_manifest(_table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word passages of the benchmark, and the items they come from."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_host_rules": op5_host_rules,
    "op6_bitpack": op6_bitpack,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_decontamination": op13_decontamination,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP1 = """
WITH RECURSIVE v AS (
 SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings),
s AS (
 SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (
 SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id"""

_OP5 = f"""
WITH d AS (
 SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM i),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
k AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM m WHERE n > 1),
k2 AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
b AS (
 SELECT d.doc_id, d.source, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
  cast(length(text) - length(translate(text, '#*$%&|<>', '')) AS bigint) AS n_symbols, len(l) AS n_lines,
  cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, cast(coalesce(k2.n, 0) AS bigint) AS n_repeat_words
 FROM d LEFT JOIN k2 ON k2.doc_id = d.doc_id),
f AS (
 SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS failed FROM b),
h AS (SELECT source, cast(count(*) AS double) AS n, cast(count(*) FILTER (WHERE failed) AS double) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(k) / sum(n) AS mean, greatest((sum(k * k / n) - sum(k) / sum(n) * sum(k)) / sum(n), 0) AS spread FROM h),
q AS (SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 1e6 END, 1), 1e6) AS strength FROM t),
r AS (SELECT source, (k + mean * strength) / (n + strength) AS rate FROM h CROSS JOIN q)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND coalesce(r.rate <= 0.5, true) AS kept, round(r.rate, 9) AS host_rate
FROM f LEFT JOIN r ON r.source = f.source"""

_OP10 = f"""
WITH RECURSIVE w AS (
 SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
 SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT w.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""

_OP11 = f"""
WITH RECURSIVE t AS (
 SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
m AS (
 SELECT doc_id, part, cast(len(w) < 100 AS int) + 2 * cast(100 * len(list_distinct(w)) < 80 * len(w) AS int)
  + 4 * cast(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS int) + 8 * cast(regexp_matches(text, '[#$%&*|]') AS int)
  + 16 * cast(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS int) AS mask FROM t),
c AS (
 SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS n_good,
  count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS n_toxic FROM m GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o(prefix, before, bit) AS (
 SELECT '', 0, 0 UNION ALL SELECT o.prefix || l.letter, o.before | o.bit, l.bit FROM o JOIN letters l ON (o.before | o.bit) & l.bit = 0),
s AS (
 SELECT part, prefix, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
  sum(n_good) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS good_lost, sum(n_toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS toxic_lost
 FROM o, c WHERE prefix <> '' GROUP BY part, prefix),
r AS (
 SELECT s.*, f.prefix AS filter_order, cast(length(s.prefix) AS int) AS step, right(s.prefix, 1) AS letter
 FROM s JOIN o f ON length(f.prefix) = 5 AND starts_with(f.prefix, s.prefix))
SELECT part, filter_order, step, cast(coalesce(kept, 0) AS bigint) AS kept, cast(coalesce(removed, 0) AS bigint) AS removed,
 cast(coalesce(redundant, 0) AS bigint) AS redundant, cast(coalesce(unique_fails, 0) AS bigint) AS unique_fails, cast(coalesce(good_lost, 0) AS bigint) AS good_lost,
 cast(coalesce(toxic_lost, 0) AS bigint) AS toxic_lost, cast(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS bigint) AS shapley FROM r"""


def _field(column: str) -> str:
    return f"coalesce(strlen(cast({column} AS varchar)) || ':' || cast({column} AS varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC = """xor(list_reduce(flatten(list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: [cast(unicode(c) AS bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, cast(4294967295 AS bigint)), 4294967295)"""

_OP12 = f"""
WITH RECURSIVE d AS (
 SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
  CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS shown FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes(tree, level, idx, n, h) AS (
 SELECT tree, 0, idx, n, leaf FROM l
 UNION ALL SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, idx, n, h) AS (
 SELECT 0, idx, n, h FROM subroots
 UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
up(tree, leaf_at, idx, n, level, h, proof) AS (
 SELECT tree, idx, idx, n, 0, shown, '' FROM l
 UNION ALL
 SELECT u.tree, leaf_at, u.idx // 2, (u.n + 1) // 2, u.level + 1, sha256(CASE WHEN u.idx % 2 = 0 THEN u.h || coalesce(s.h, '') ELSE s.h || u.h END), proof || coalesce(s.h, '')
 FROM up u LEFT JOIN nodes s ON s.tree = u.tree AND s.level = u.level AND s.idx = xor(u.idx, 1) WHERE u.n > 1),
rise(tree, leaf_at, idx, n, level, h, proof) AS (
 SELECT up.tree, leaf_at, subroots.idx, subroots.n, 0, up.h, proof FROM up JOIN subroots ON subroots.tree = up.tree WHERE up.n = 1
 UNION ALL
 SELECT u.tree, leaf_at, u.idx // 2, (u.n + 1) // 2, u.level + 1, sha256(CASE WHEN u.idx % 2 = 0 THEN u.h || coalesce(s.h, '') ELSE s.h || u.h END), proof || coalesce(s.h, '')
 FROM rise u LEFT JOIN tops s ON s.level = u.level AND s.idx = xor(u.idx, 1) WHERE u.n > 1)
SELECT l.doc_id, l.leaf, subroots.h AS subroot, tops.h AS root, sha256(rise.proof) AS proof_sha256, rise.h AS folded_root, rise.h = tops.h AS verified
FROM l JOIN subroots ON subroots.tree = l.tree JOIN rise ON rise.tree = l.tree AND rise.leaf_at = l.idx AND rise.n = 1 JOIN tops ON tops.n = 1"""

_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_RUNS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {_RUNS} AS w FROM benchmark),
g AS (
 SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
 FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT m FROM g),
p AS (SELECT k, m, w, unnest(range(1, cast(len(w) - m + 2 AS bigint))) AS i FROM d JOIN s ON len(w) >= m),
h AS (SELECT p.k, p.i, p.m, g.item FROM (SELECT k, i, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM p) p JOIN g ON g.m = p.m AND g.gram = p.gram),
n AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS j FROM h) GROUP BY k),
i AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY k)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN i ON i.k = d.k"""

#: The others hold trained models, hashes or dynamic programmes; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": _OP1, "op5_host_rules": _OP5, "op10_jaccard_join": _OP10,
                              "op11_filter_audit": _OP11, "op12_merkle_manifest": _OP12, "op13_decontamination": _OP13}
