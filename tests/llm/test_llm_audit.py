"""Operators 11 to 13 against brute force: null, empty and very long texts, copies, repeated rows and ids, ties, extra columns with clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thinkframe.llm import decontam, merkle
from thinkframe.llm.filter_audit import enumerate_orders, filter_audit, mask_cells

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "n long, part string, mask int, idx long, tree string, spans int, words int, `a.b` string, digest string, first boolean")
EXTRA = (1, "p", 2, 3, "t", 4, 5, "x", "y", True)


def make_rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = []
    for i in range(70):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 260)))
        if i % 5 == 0:
            text = text.upper()
        if i % 9 == 0:
            text += " # 100%"
        if i % 8 == 3 and rows:
            text = rng.choice(rows)[1]
        rows.append((i, text, ["en", "de", None, "é", ""][i * i % 5], "s"))
    rows += [(100, None, "en", "a"), (101, "", "en", None), (102, " \n\t ", None, None), (None, "a b", "de", "s"), (None, rows[3][1], "en", "s"),
             (104, "ünï 日本語 Text" * 30, "solo", "s"), (105, "x" + " y" * 30000, "en", "s"), rows[4], rows[4], (4, "another text", "de", "s"), (106, rows[4][1], "de", "s")]
    return [(*r, None if r[0] == 8 else len(r[1] or ""), *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LABELS = [(i, i % 2, (i // 2) % 2, "z") for i in range(0, 70, 3)] + [(3, 0, 0, "z"), (None, 1, 1, "z"), (9, None, None, "z"), (100, 1, 1, "z"), (999, 1, 1, "z")]


def expected_audit(rows, labels):
    def fails(r):
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                "E": r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == t for o in rows)}
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, *_ in labels if t == 1 and d is not None}
    out, shares = {}, {}
    for part in {r[2] or "" for r in rows}:
        members = [(r[0], fails(r)) for r in rows if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                f, before = order[step - 1], order[:step - 1]
                reach = [(d, x) for d, x in members if not any(x[b] for b in before)]
                gone = [d for d, x in reach if x[f]]
                out[part, "".join(order), step] = [
                    len(reach) - len(gone), len(gone), sum(x[f] and any(x[b] for b in before) for _, x in members),
                    sum(x[f] and sum(x.values()) == 1 for _, x in members), sum(d in good for d in gone), sum(d in toxic for d in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_every_order_of_the_filters(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, good string")
    out = filter_audit(docs, labels)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    want = expected_audit(rows, LABELS)
    assert len(want) == 600 * len({r[2] or "" for r in rows}) and got == want


def test_audit_of_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in filter_audit(docs, labels).collect()} == {(0, 0)}


def test_recursion_has_every_prefix_once(spark):
    cells = mask_cells(spark.createDataFrame([("p", 3, True, False, 2), ("p", 3, False, True, 1), ("q", 0, False, False, 5)], "part string, mask int, good boolean, toxic boolean, n long"))
    walk = enumerate_orders(spark, cells, "ABC").collect()
    assert sorted(r.prefix for r in walk if r.part == "q") == sorted("".join(p) for k in (1, 2, 3) for p in itertools.permutations("ABC", k))
    assert all(r.applied == r.before | r.bit and r.before & r.bit == 0 for r in walk)
    assert {(r.part, r.mask, r.n, r.n_good, r.n_toxic) for r in walk} == {("p", 3, 3, 2, 1), ("q", 0, 5, 0, 0)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_manifest(rows, arity=2):
    def leaf(r, add=0):
        n = None if r[4] is None else r[4] + add
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])))

    def build(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            lo = i - i % arity
            out.append((level[lo:i], level[i + 1:lo + arity]))
            i //= arity
        return out

    def fold(h, sides):
        for left, right in sides:
            h = sha("".join([*left, h, *right]))
        return h

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[t] = build([leaf(r) for r in trees[t]])
    top = build([built[t][-1][0] for t in names])
    out = []
    for at, t in enumerate(names):
        for i, r in enumerate(trees[t]):
            sides = siblings(built[t], i) + siblings(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = fold(leaf(r, 1) if hit else leaf(r), sides)
            out.append((r[0], leaf(r), built[t][-1][0], top[-1][0], sha("".join(h for left, right in sides for h in [*left, *right])), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest(docs, rows, arity):
    got = sorted(map(tuple, merkle.merkle_manifest(docs, arity=arity).collect()), key=str)
    assert got == expected_manifest(rows, arity)
    tampered = [r for r in got if not r[-1]]
    assert tampered and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in tampered)


def test_manifest_of_one_row_one_tree_and_none(spark, docs, rows):
    for some in (rows[:1], [r for r in rows if r[2] == "en"], [rows[0]] * 9):
        got = sorted(map(tuple, merkle.merkle_manifest(spark.createDataFrame(some, SCHEMA)).collect()), key=str)
        assert got == expected_manifest(some)
    assert merkle.merkle_manifest(docs.limit(0)).count() == 0


def test_largest_length_can_be_tampered_with(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0][:2]
    rows = [(i, "t", "en", "s", 2**63 - 1, *EXTRA) for i in ids]
    assert [r.verified for r in merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()] == [False, False]


def test_numbers_are_gapless_when_equal_rows_fill_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("tree"), F.lit(7).cast("long").alias("k"), F.lit(b"d").alias("digest"))
    got = merkle.numbered(rows.repartition(5), ["k"]).collect()
    assert sorted((r.tree, r.idx, r.n) for r in got) == [("a", i, 1000) for i in range(1000)] + [("b", i, 2000) for i in range(2000)]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected_contamination(rows, items, window=10):
    windows = {}
    for name, text in items:
        w = words_of(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(name)
    sizes = {len(k) for k in windows}
    out = []
    for r in rows:
        w, hit, names = words_of(r[1]), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    names |= windows[tuple(w[i:i + size])]
        names = sorted(str(n) for n in names if n is not None)
        out.append((r[0], len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return sorted(out, key=str)


def make_items(rows):
    long = words_of(rows[6][1] if len(words_of(rows[6][1])) > 40 else rows[7][1])
    text = " ".join
    return [(1, text(long[3:30])), (2, text(long[3:13]).upper()), (20, "no such words at all anywhere in these texts my friend"), (3, text(long[5:12])), (4, ""), (5, None), (6, "?!"),
            (None, text(words_of(rows[10][1])[:12])), (7, text(words_of(rows[12][1]))), (7, text(words_of(rows[13][1])[-11:])), (1, text(long[3:30])), (8, "日本語"), (9, "y " * 400)]


@pytest.fixture(scope="module")
def planted(rows):
    """Rows with pieces of items at text borders, next to other passages and over punctuation."""
    items = make_items(rows)
    a, b = items[0][1], items[3][1]
    more = [(300, a, "en", "s"), (301, a.replace(" ", "-*- ") + "." + b, "en", "s"), (302, b + " " + b, "en", "s"), (303, "日本語", "en", "s"), (304, " ".join(a.split()[:9]), "en", "s"),
            (305, " ".join(a.split()[-10:]), "en", "s"), (306, " ".join(a.split()[1:]) + " " + a, "en", "s")]
    return rows + [(*r, 1, *EXTRA) for r in more], items


ITEMS = "item_id long, text string, doc_id int, spans string"


def test_contamination(spark, planted):
    rows, items = planted
    bench = spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = decontam.contamination(docs, bench)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = expected_contamination(rows, items)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert sum(w[-1] for w in want) >= 8 and not all(w[-1] for w in want)
    clean = decontam.without_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in docs.collect() if not expected_contamination([r], items)[0][-1])


def test_contamination_in_blocks_and_small_shards(spark, planted, monkeypatch):
    rows, items = planted
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    bench = spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS)
    assert len(list(decontam.benchmark_blocks(bench))) > 3
    got = decontam.contamination(spark.createDataFrame(rows, SCHEMA), bench)
    assert sorted(map(tuple, got.collect()), key=str) == expected_contamination(rows, items)


def test_contamination_of_empty_tables(spark, planted):
    rows, items = planted
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS)
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert {(r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(docs, bench.limit(0)).collect()} == {(0, 0, False)}


def test_longest_matches(spark, planted):
    rows, items = planted
    named = [(n, t) for n, t in items if n in (1, 3, 8, 20)][:4]
    got = {(r.item, r.start): (r.words, r.doc_id, r.doc_start) for r in decontam.longest_matches(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(named, "item_id long, text string")).collect()}
    texts = [(r[0], words_of(r[1])) for r in rows if r[0] is not None]
    want = {}
    for name, text in named:
        w = words_of(text)
        for s in range(len(w) - min(len(w), 10) + 1):
            best = 0
            for _, d in texts:
                for i in range(len(d)):
                    k = 0
                    while s + k < len(w) and i + k < len(d) and w[s + k] == d[i + k]:
                        k += 1
                    best = max(best, k)
            if best >= min(len(w), 10):
                want[str(name), s] = best
    assert {k: v[0] for k, v in got.items()} == want
    by_id = dict(texts)
    for (name, s), (k, doc, at) in got.items():
        item = next(words_of(t) for n, t in named if str(n) == name)
        assert by_id[doc][at:at + k] == item[s:s + k] or any(d[at:at + k] == item[s:s + k] for i, d in texts if i == doc)


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(5)
    for alphabet in (2, 3, 50):
        words = np.append(rng.integers(0, alphabet, 400), np.zeros(401, dtype=np.int64))
        key = decontam.packed_words(words, 6, 3)
        order = decontam.suffix_array(words, key, 3, 400).tolist()
        assert sorted(order) == np.flatnonzero(words).tolist()

        def run(i):  # up to the first 0, where no search goes on
            return words[i:i + 1 + int(np.argmax(words[i:] == 0))].tolist()
        assert all(run(a) <= run(b) for a, b in zip(order, order[1:]))
