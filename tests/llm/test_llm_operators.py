"""Operators of thinkframe.llm against brute force on a small table with hard cases: null and empty texts,
a very long text, copies, near copies, repeated rows, and extra columns whose names operators use inside."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import thinkframe.llm.suffix_dedup as suffix_dedup
from thinkframe.llm import bitpack, host_rules, lm_scoring, mixing, packing, shards
from thinkframe.llm.components import components
from thinkframe.llm.embeddings import embedding_links
from thinkframe.llm.jaccard_join import _Region, jaccard_components
from thinkframe.llm.language_id import identify_languages, learn_languages, with_language
from thinkframe.llm.staging import shared_path
from thinkframe.llm.tokens import Encoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, th long, key string, label long, size int, point long, n long"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))


def make_rows():
    rng = random.Random(4)
    rows, bases = [], []
    for i in range(90):
        words = [word(rng) for _ in range(rng.randint(1, 160))]
        if i % 7 == 3 and bases:  # near copies
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = word(rng)
        if i % 11 == 5 and bases:  # a shared passage
            words[1:1] = bases[0][:60]
        if i % 13 == 6:
            words += words[-12:] * 3
        bases.append(words)
        text = " ".join(words[: len(words) // 2]).capitalize() + ".\n" + " ".join(words[len(words) // 2:]) + ("," if i % 2 else "  \n x")
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", "B", None, "é"][i * i % 5]))
    rows.append((200, None, "en", "a"))
    rows.append((201, "", "en", "a"))
    rows.append((202, " \n\t ", None, None))
    rows.append((203, "one two", "de", "solo"))
    rows.append((204, "One TWO", "de", "solo"))
    rows.append((205, "123 456 #$% 78", "de", "b"))
    rows.append((206, "ünïcode 日本語 text é " * 40, "de", "b"))
    rows.append((207, "long " + " ".join(word(rng) for _ in range(9000)), "en", "a"))
    rows.append((208, "same line of words here\n" * 30, "en", "B"))
    rows += [rows[3], (209, rows[3][1], "en", "B"), (210, rows[3][1], "en", "a")]  # a repeated row and copies
    return [(*r, len(r[1] or ""), 1, 2, "k", 3, 4, 5, 6) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def labels(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = labels({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {7, 3} | set()
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    vectors = [base[i % 12] + rng.normal(size=16) * (0.03 + 0.05 * (i % 3)) for i in range(150)]
    data = [(i, [float(np.float32(x)) for x in v], i % 12 % 4, "x", 1) for i, v in enumerate(vectors)]
    data += [(1000 + i, data[0][1], data[0][2], "x", 1) for i in range(700)]  # a hot group of copies, over one block
    data += [(2000 + i, [x * (1 + 1e-4 * i) for x in data[5][1]], data[5][2], "x", 1) for i in range(600)]  # and of scaled ones
    data += [(5001, None, 1, "x", 1), (5002, [0.0] * 16, 1, "x", 1), (5003, [float("nan")] * 16, 1, "x", 1), (5004, data[0][1], None, "x", 1),
             (5005, [None] + data[0][1][1:], 1, "x", 1), (5006, [], 1, "x", 1), (5007, data[0][1][:8], data[0][2], "x", 1), (None, data[0][1], data[0][2], "x", 1),
             (5008, [float("inf")] * 16, 1, "x", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, point string, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_links(df).collect()}
    sound = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab, *_ in data if i is not None and i < 5001 or i == 5007]
    n, links = Counter(), []
    by = defaultdict(list)
    for i, v, lab in sound:
        by[lab, len(v)].append((i, v / np.linalg.norm(v)))
    for group in by.values():
        m = np.stack([v for _, v in group])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.98, 1))):
            n[group[a][0]] += 1
            n[group[b][0]] += 1
            links.append((group[a][0], group[b][0]))
    ids = [r[0] for r in data if r[0] is not None]
    comp = labels(ids, links)
    assert got.pop(None) == (0, None, None)
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in ids}
    assert embedding_links(df.limit(0)).count() == 0


def test_op2_mix(docs, rows, nothing):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words_of(r[1]))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:  # targets above three times the source stop there
        share = (total - sum(3 * size[s] for s in full)) / max(1, sum(w for s, w in weight.items() if s not in full))
        more = {s for s in names if s not in full and share * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * size[s] if s in full else share * weight[s] for s in names}
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        # A 9,004-word document leaves its source's budget to documents that may come three times each.
        limit = min(target[s], 3 * sum(len(words_of(r[1])) for r in rows if r[3] == s and len(words_of(r[1])) <= target[s]))
        assert limit - 3 < taken[s] <= target[s] + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_documents(docs.repartition(2)).collect()), key=str)
    assert mixing.mix_documents(nothing).count() == 0


def test_op2_fit_reaches_every_reachable_budget():
    rng = random.Random(1)
    for _ in range(60):
        sizes = rng.sample(range(1, 40), rng.randint(1, 6))
        counts = [rng.randint(1, 4) for _ in sizes]
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + s * k for r in reach for k in range(c + 1)}
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts)))
        take = mixing.fit_counts(np.array(sizes), np.array(counts), budget)
        got = sum(int(t) * s for t, s in zip(take, sizes))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and got <= budget
        assert got == max(r for r in reach if r <= budget)


def minimax(sizes, shards_):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, used, room = (lo + hi) // 2, 1, 0
        for s in sizes:
            if room + s > mid:
                used, room = used + 1, 0
            room += s
        lo, hi = (lo, mid) if used <= shards_ else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("first_bits", [3, 14])
def test_op3_capacity_is_the_least(docs, rows, nothing, monkeypatch, first_bits):
    monkeypatch.setattr(shards, "FIRST_BITS", first_bits)
    got = shards.shard_rows(docs.where("doc_id <> 207"), shards=7).collect()
    data = [r for r in rows if r[0] != 207]
    assert len(got) == len(data)
    text = {r[0]: r[1] for r in data}
    where, bytes_, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 7
        where[t].add(r.shard)
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()), 4)
    order = [r.s for r in docs.where("doc_id <> 207").groupBy(h.alias("h")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("s")).orderBy("h").collect()]
    assert max(bytes_.values()) == minimax(order, 7)
    assert shards.shard_rows(nothing).count() == 0


def test_op4_held_out(spark, docs, nothing):
    rng = random.Random(9)
    speech = {"en": "the of and to in is that for it was on are with they".split(), "de": "der die und in den von zu das mit sich des auf für ist".split(),
              "fr": "de la le et les des en un du une que est pour qui".split()}
    data = [(i, " ".join(rng.choice(speech[lang]) for _ in range(30)), lang, 1.5) for i, lang in enumerate(list(speech) * 40)]
    data += [(500, None, "en", 0.1), (501, "", None, 0.1), (502, "12 34 !", "de", 0.1), (503, "the and " * 20000, "en", 0.1), (503, "the and " * 20000, "en", 0.1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score double")
    out = identify_languages(df, F.col("doc_id") % 5 == 0).collect()
    assert len(out) == len(data)
    truth = {r[0]: r[2] for r in data}
    for r in out:
        assert r.held_out == (r.doc_id % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (500, 501, 502) else truth[r.doc_id])
    assert identify_languages(nothing, F.lit(False)).count() == 0
    untaught = identify_languages(docs, F.lit(True)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in untaught] == ["und"]


def plain_ppm(taught):
    """Code lengths of a text by language, byte by byte, from {language: texts}."""
    seen = {lang: defaultdict(Counter) for lang in taught}
    for lang, texts in taught.items():
        for t in texts:
            b = b"\n" * 4 + t.encode()
            for i in range(4, len(b)):
                for k in range(5):
                    seen[lang][b[i - k:i]][b[i]] += 1

    def escape(c):
        return math.log2((c.total() + len(c)) / len(c)) if c else 0.0

    def bits(lang, context, byte):
        c = seen[lang].get(context, Counter())
        if c[byte]:
            return math.log2((c.total() + len(c)) / c[byte])
        return escape(c) + (bits(lang, context[1:], byte) if context else 8.0)

    def units(lang, context, byte):
        if any(s.get(context, Counter())[byte] for s in seen.values()):
            return round(4096 * bits(lang, context, byte))
        return round(4096 * escape(seen[lang].get(context, Counter()))) + (units(lang, context[1:], byte) if context else 8 * 4096)

    def lengths(t):
        b = b"\n" * 4 + t.encode()
        return {lang: sum(units(lang, b[i - 4:i], b[i]) for i in range(4, len(b))) for lang in sorted(taught)}
    return lengths


def test_op4_code_lengths_and_scores_by_brute_force(spark, docs, rows):
    taught = defaultdict(set)
    for r in rows:
        if r[0] % 5 and r[1] and r[2]:
            taught[r[2]].add(r[1])
    plain = plain_ppm(taught)
    texts = [r[1] for r in rows if len(r[1] or "") < 3000] + ["e", "zq", "日本 語", "Wörter, die keiner kennt\x00\x01"]
    trees = learn_languages(docs.where("doc_id % 5 <> 0"))
    full = [t for t in texts if t]
    data = np.frombuffer("".join(full).encode(), dtype=np.uint8)
    got = trees.code_lengths(data, np.cumsum([0, *[len(t.encode()) for t in full]]))
    assert trees.languages == sorted(taught)
    for t, row in zip(full, got.tolist()):
        assert all(abs(a - b) <= 2 for a, b in zip(row, plain(t).values()))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in with_language(asked, trees).collect():
        t = texts[r.row.doc_id]
        if not re.search(r"[^\W\d_]", t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        need = {lang: n / 4096 for lang, n in plain(t).items()}
        best = min(need.values())
        assert need[r.lang_pred] <= best + 1e-3
        assert abs(r.score - 1 / sum(2.0 ** -min(n - best, 1000) for n in need.values())) < 1e-3


def rule_counts(t):
    t = t or ""
    words = words_of(t)
    lines = [x for x in t.split("\n") if words_of(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    cover = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(lines)


def test_op5_rules_and_hosts(spark, docs, rows, nothing):
    bad = [(900 + i, "short", "en", "junk.example", 5, 1, 2, "k", 3, 4, 5, 6) for i in range(30)] + [(950, rows[0][1] + " " + "more words " * 3, "en", "junk.example", 5, 1, 2, "k", 3, 4, 5, 6)]
    table = rows + bad
    got = host_rules.host_quality(docs.unionByName(spark.createDataFrame(bad, SCHEMA))).collect()
    assert len(got) == len(table)
    seen = defaultdict(lambda: [0, 0])
    counts = {}
    for r in table:
        n, chars, sym, dup, rep, lines = rule_counts(r[1])
        failed = n < 20 or 100 * rep > 30 * n
        counts[r[0]] = (n, chars, sym, dup, rep, failed, r[3])
        if r[3] is not None:
            seen[r[3]][0] += 1
            seen[r[3]][1] += failed or 10 * sym > n or 10 * dup > 3 * lines
    total, fails = sum(a for a, _ in seen.values()), sum(b for _, b in seen.values())
    mean = fails / total
    spread = sum(a * (b / a - mean) ** 2 for a, b in seen.values()) / total
    strength = min(max(mean * (1 - mean) / spread - 1, 1), 1e6)
    for r in got:
        n, chars, sym, dup, rep, failed, host = counts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, sym, dup, rep, failed)
        a, b = seen.get(host, (0, 0))
        assert r.kept == (not failed and (host is None or (b + mean * strength) / (a + strength) <= 0.5))
    assert not next(r for r in got if r.doc_id == 950).kept
    assert host_rules.host_quality(nothing).count() == 0


def test_op6_round_trip(spark, docs, rows, nothing):
    enc = Encoder(default_vocabulary())
    got = sorted(bitpack.packed_digest(docs).collect(), key=lambda r: (r.doc_id, r.start))
    start = 0
    for r, (doc_id, text) in zip(got, sorted(((r[0], r[1]) for r in rows), key=lambda x: x[0]), strict=True):
        ids = np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert bitpack.packed_digest(nothing).count() == 0
    folder = shared_path(spark, "random-access")
    assert bitpack.write_packed(docs, folder, file_mb=1).agg(F.sum("n_ids")).first()[0] == start


def test_packed_files_follow_each_other_by_number(spark):
    """Beyond any width of their names: a million partitions and ten thousand files in one."""
    numbers = [(p, m) for p in (0, 1, 999_999, 1_000_000, 1_000_001, 3_100_000, 10**9) for m in (0, 1, 9_999, 10_000, 1_000_000)]
    rows = [(p, m, 7 + i, bitpack.file_name(p, m)) for i, (p, m) in enumerate(numbers)]
    got = bitpack.first_ids(spark.createDataFrame(rows[::-1], "part long, made long, n_ids long, name string"), group=4)
    want, at = {}, 0
    for p, m, n, _ in sorted(rows):
        want[p, m], at = at, at + n
    assert {(r.part, r.made): r.first_id for r in got.collect()} == want


def test_rows_of_one_id_fill_several_files(spark):
    rows = [(None, f"{i:04d} " * 400) for i in range(300)] + [(4, "x"), (4, "y")]
    got = bitpack.packed_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 300 + [4, 4]


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_op6_format(width):
    rng = np.random.default_rng(width)
    ids = [rng.integers(0, 2**width, n).astype("<u4") for n in (0, 1, 63, 5000, 20000, 0)]
    f = bitpack.PackedFile(bitpack.file_bytes(list(range(6)), ids, width, 128))
    flat = np.concatenate(ids)
    assert all((x == y).all() and len(x) == len(y) for (_, _, x), y in zip(f.documents(), ids))
    for a, b in ((0, 1), (100, 300), (127, 129), (6000, 6000), (25000, len(flat))):
        assert (f.ids(a, b) == flat[a:b]).all()
    assert len(f.data) < len(flat) * width / 8 + 128 * width / 8 + 8 * len(flat) / 128 + 200


def test_tokens_equal_the_library():
    rng = random.Random(2)
    enc = Encoder(default_vocabulary())
    texts = ["".join(rng.choice(" \n\ta.,'s1é\x1c|") for _ in range(rng.randrange(0, 40))) for _ in range(1500)] + [None, "<|endoftext|> a", "日本語 テスト。 2.5."]
    want = [e.ids for e in enc.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == want


def test_added_tokens_equal_a_fresh_library():
    from tokenizers import Tokenizer
    fresh = Tokenizer.from_file(default_vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y, z. <|endoftext|><|endoftext|>.", "a <|endof", "text|> b", "", "plain words. here", None, "é <|endoftext|>\n"]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0] and want[0] == [64, 220, 50256, 275]
    for some in (texts, texts[::-1]):
        got = [x.tolist() for x in Encoder(default_vocabulary()).encode(pa.array(some))]
        assert got == (want if some is texts else want[::-1])


@pytest.mark.parametrize("frequent", [20, 150_000])
def test_op7_scores(docs, rows, nothing, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT_WORDS", frequent)
    got = lm_scoring.score_texts(docs, F.col("doc_id") % 7 == 2).collect()
    tokens = [(r[0], [*words_of(low(r[1])), None]) for r in rows]
    c = Counter(t for i, ts in tokens if i % 7 != 2 for t in ts)
    total, kinds = sum(c.values()), len(c)
    want = sorted((i, i % 7 == 2, len(ts), sum(c[t] > 0 for t in ts), total, round(sum(math.log10((c[t] + 1) / (total + kinds + 1)) for t in ts), 5)) for i, ts in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_scoring.score_texts(nothing, F.lit(False)).count() == 0
    assert {r.n_known for r in lm_scoring.score_texts(docs, F.lit(True)).collect()} == {0}


@pytest.mark.parametrize("round_tokens", [3000, 4_000_000])
def test_op7_score_by_plain_sums(docs, rows, monkeypatch, round_tokens):
    caught, real = {}, lm_scoring.train

    def train(texts, lbl, keys, *more):
        real(texts, lbl, keys, *more)
        caught.update(p={k: v.astype(float) for k, v in lbl.p.items()}, unit={k: lm_scoring.CLASSES + i for i, k in enumerate(keys.tolist())})
    monkeypatch.setattr(lm_scoring, "train", train)
    monkeypatch.setattr(lm_scoring, "ROUND_TOKENS", round_tokens)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in lm_scoring.score_texts(docs, F.col("doc_id") % 7 == 2).collect())
    p, own = caught["p"], caught["unit"]
    assert own

    def told(w):
        data = np.frombuffer(w.encode(), dtype=np.uint8)
        at = np.array([0]), np.array([len(data)])
        return int(lm_scoring.word_hashes(data, *at).view(np.int64)[0]), int(lm_scoring.word_classes(data, *at)[0])
    count = Counter(w for r in rows if r[0] % 7 != 2 for w in words_of(low(r[1])))
    name = {w: told(w) for r in rows for w in words_of(low(r[1]))}
    n, kinds = Counter(), Counter()
    for w, c in count.items():
        if name[w][0] not in own:
            n[name[w][1]] += c
            kinds[name[w][1]] += 1
    known = {}

    def log_p(a, b):
        if (a, b) not in known:
            s = (p["two"][a] + p["one"][b]) @ p["target"].T + p["bias"][:, 0]
            known[a, b] = (s - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10)
        return known[a, b]

    def score(t):
        total, two, one, before = 0.0, 0, 0, 0
        for w in [*words_of(low(t)), None]:
            key, cls = name[w] if w else (None, 0)
            unit = own.get(key, cls)
            total += log_p(two, one)[unit]
            if w and unit == cls:
                total += math.log10((count[w] + 1) / (n[cls] + kinds[cls] + 1))
            two, before, one = before, cls, unit
        return total
    want = sorted((r[0], len(words_of(r[1])) + 1, score(r[1])) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) <= 2e-4 * g[1] + 1e-3 for g, w in zip(got, want))


def test_op7_table_is_normalised():
    model = lm_scoring.LogBilinear(np.array([5, 700, 9000]), np.array([10, 5, 1]), steps=20)
    rows_ = (10.0 ** model.table().astype(float)).reshape(-1, lm_scoring.CLASSES).sum(axis=1)
    assert np.allclose(rows_, 1, atol=1e-4)


def test_op7_learns_which_word_follows_which(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"{a}{b}zz" for a in "abcdef" for b in "abcdef"]  # one class: each word is followed by the next or the one after
    texts = []
    for i in range(400):
        at, words = rng.randrange(36), []
        for _ in range(50):
            words.append(names[at])
            at = (at + rng.randint(1, 2)) % 36
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)

    def held_out():
        return lm_scoring.score_texts(df, F.col("doc_id") % 5 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    learned, base = held_out()
    assert learned > 0.75 * base
    monkeypatch.setattr(lm_scoring, "train", lambda *_: None)
    assert learned > 0.75 * held_out()[0]


def test_op7_units_are_normalised():
    rng = np.random.default_rng(5)
    model = lm_scoring.LogBilinear(np.array([5, 700, 9000]), np.array([10, 5, 1]), steps=20)
    model.widen(np.array([3, 3, 40]), np.arange(lm_scoring.CLASSES + 3.0))
    p = model.p
    for k in p:
        p[k] = p[k] + rng.normal(0, 1, p[k].shape).astype(np.float32)
    totals = model.log_totals(np.array([2, 97]))
    for i, b in enumerate((2, 97)):
        score = (p["two"] + p["one"][b]) @ p["target"].T + p["bias"][:, 0] - totals[i][:, None]
        assert np.allclose(np.exp(score.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_op8_pieces(docs, rows, nothing):
    enc = Encoder(default_vocabulary())
    want = sorted(([*enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows), key=len)
    got = packing.pack_documents(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    ids = {r[0]: [*enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    covered = Counter()
    for r in got:
        z = np.array(ids[r.doc_id], dtype="<u4")
        assert r.doc_tokens == len(z) and r.ids_crc32 == zlib.crc32(z[r.start:r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
    times = Counter(r[0] for r in rows)
    assert covered == {i: len(ids[i]) * n for i, n in times.items()} and sum(map(len, want)) == sum(covered.values())
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("window_cost", [0, 3])
def test_op8_cuts_are_optimal(window_cost):
    def pad(length):
        return 0 if length & (length - 1) == 0 else 16 - length

    rng = random.Random(6)
    for _ in range(60):
        places = np.cumsum([rng.randint(1, 10) for _ in range(rng.randint(1, 14))])
        cost = np.array([rng.randint(0, 6) for _ in places])
        best = [0] + [10**9] * len(places)
        at = [0, *places.tolist()]
        for j in range(1, len(at)):
            best[j] = min(best[i] + pad(at[j] - at[i]) + window_cost + int(cost[j - 1]) for i in range(j) if at[j] - at[i] <= 16)
        cuts = packing.best_cuts(places, cost, 16, window_cost)
        price = dict(zip(places.tolist(), cost.tolist()))
        assert all(0 < b - a <= 16 for a, b in zip([0, *cuts], cuts))
        assert sum(pad(b - a) + window_cost + price[b] for a, b in zip([0, *cuts], cuts)) == best[-1] and cuts[-1] == places[-1]


def test_op8_plans_follow_places(spark):
    """Places by a plain running sum over the ordered rows; a copied row spreads over the plans that its copies begin in."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, 40, 500]), rng.choice("abc") * rng.randrange(0, 60)) for _ in range(150)] + [(7, "same text")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.col("text")
    keyed = df.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("h"),
                      (F.octet_length(text) + 1).cast("long").alias("size"))
    at, want = 0, Counter()
    for r in sorted(keyed.collect(), key=lambda r: (not r.no_id, r.id, r.h, r["size"])):
        want[tuple(r), at // 100] += 1
        at += r["size"]
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = packing.plan_places(keyed, 100).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert {((r.no_id, r.id, r.h, r["size"]), r.plan): r.copies for r in got} == want
    assert len({p for k, p in want if k[1] == 7}) > 5


def test_op8_does_not_depend_on_partitions(spark, docs):
    noted = docs.withColumn("a.b", F.lit(1)).withColumn("plan", F.lit(2)).withColumn("h", F.lit(3))
    found = []
    for parts in ("4", "8", "61"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found.append(sorted(map(tuple, packing.pack_documents(noted.repartition(int(parts)), plan_bytes=20_000).collect()), key=repr))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2] and len({r[5] >> 32 for r in found[0]}) > 1


def removed(rows, n):
    seen, out = set(), {}
    for i, t in sorted({(r[0], r[1] or "") for r in rows}):
        b = t.encode()
        keep = bytearray(b"\1" * len(b))
        for j in range(len(b) - n + 1):
            w = b[j:j + n]
            if w in seen:
                keep[j:j + n] = bytes(n)
            seen.add(w)
        spans = sum(not k and (j == 0 or keep[j - 1]) for j, k in enumerate(keep))
        out[i] = (len(b), keep.count(0), spans, hashlib.sha256(bytes(x for x, k in zip(b, keep) if k)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 4096])
def test_op9_digest(docs, rows, nothing, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    got = suffix_dedup.substring_digest(docs).collect()
    want = removed(rows, 100)
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(w[1] > 0 for w in want.values()) > 5
    assert suffix_dedup.substring_digest(nothing).count() == 0
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    ascii_ = {r.doc_id: r.text for r in left.collect() if r.text is not None and r.doc_id < 200}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][3] for i, t in ascii_.items())


def test_op9_prefix_classes():
    rng = np.random.default_rng(0)
    for sigma, n in ((2, 400), (4, 600), (3, 50)):
        s = np.append(rng.integers(1, sigma + 1, 400), 0)
        order, first = suffix_dedup.prefix_classes(s, n // 50)
        length = n // 50
        strings = [tuple(s[i:i + length]) for i in order]
        inner = [i for i in range(1, len(s)) if len(strings[i]) == length == len(strings[i - 1])]
        assert all(first[i] == (strings[i] != strings[i - 1]) for i in inner)


def shingles(t):
    w = words_of(low(t))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_op10_components(docs, rows, nothing):
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = labels(ids, links)
    got = jaccard_components(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), comp[i]) for i in ids}
    assert len(links) > 5
    assert jaccard_components(nothing).count() == 0


def test_op10_region_recursion_is_exact():
    rng = random.Random(8)
    sets = []
    for c in range(12):
        base = rng.sample(range(c * 400, c * 400 + 900), 120)
        for _ in range(25):
            s = set(base)
            for _ in range(rng.randint(0, 16)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(6000))
            sets.append(np.array(sorted(s), dtype=np.uint64))
    region = _Region(sets, 75)
    region.join()
    py = [set(s.tolist()) for s in sets]
    want = labels(range(len(py)), [(a, b) for a in range(len(py)) for b in range(a) if 100 * len(py[a] & py[b]) >= 75 * len(py[a] | py[b])])
    assert [region.root(i) for i in range(len(py))] == [want[i] for i in range(len(py))]


def test_null_ids_in_every_document_operator(spark):
    """Rows without an id, one of them twice and one a copy of a row with an id, beside a null text."""
    text = " ".join(f"w{i}" for i in range(60))
    data = [(None, text, "en", "a"), (None, text, "en", "a"), (None, None, "en", "a"), (4, text, "en", None), (5, text + " x", None, "a"), (6, "short one", "de", "b")]
    df = spark.createDataFrame([(*r, 1.0) for r in data], "doc_id long, text string, lang string, source string, score double")
    ids = sorted((r[0] for r in data), key=lambda x: (x is not None, x))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0

    def found(out):
        rows = out.collect()
        assert sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x)) == ids
        return rows

    assert all(r.taken <= 3 * r.size for r in found(mixing.mix_documents(df)))
    assert len({r.shard for r in found(shards.shard_rows(df, 3)) if r.doc_id in (None, 4) and r.text_crc32 is not None}) == 1
    assert all(r.held_out is False for r in found(identify_languages(df, fold)) if r.doc_id is None)
    assert sum(r.n_words for r in found(host_rules.host_quality(df))) == 4 * 60 + 1 + 2
    packed = found(bitpack.packed_digest(df))
    at = 0
    for r in sorted(packed, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(packed, key=lambda r: r.start)] == ids
    assert all(r.score < 0 for r in found(lm_scoring.score_texts(df, fold)))
    pieces = packing.pack_documents(df).collect()
    assert sum(r.length for r in pieces) == at and sum(r.doc_id is None for r in pieces) == 3
    digest = found(suffix_dedup.substring_digest(df))
    assert {r.n_removed for r in digest if r.doc_id in (4, 5)} == {len(text)}
    joined = found(jaccard_components(df))
    assert {r.doc_id: r.component_id for r in joined} == {None: None, 4: 4, 5: 4, 6: 6}
