"""Operator 7: scoring texts with a log-bilinear model trained by noise-contrastive estimation.

The units of the model are the most frequent words, each with an input and a target vector of its
own, and classes of the other words by their length and last letters. The next unit is predicted from the unit
before it and the class two before. A class model in numpy, from drawn class trigrams, gives the start; then tasks
take gradient steps over every token of the training corpus, so steps grow with it, and their models are averaged, each unit by how
often a task met it. One batched matrix product over all contexts then normalises the model exactly. Within a class
a word without vectors has the add-one share of its count, counts being taken over the whole training corpus.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import ship_package, staged
from .words import KeyIndex, mix, text_slices, word_hashes, word_spans

CLASSES = 96
END = 0
DIM = 24
#: Noise units a minibatch, shared by its rows.
NOISE = 64
#: Steps of the class model that the units start from.
STEPS, BATCH = 1200, 2048
#: Words with vectors of their own, at most, and the least count of one; the normaliser's cost grows with the square.
OWN_WORDS, LEAST_COUNT = 8000, 8
#: Times the corpus is read, whatever its size, and the tokens that a task steps over before the tasks' models are averaged.
PASSES, ROUND_TOKENS = 2, 4_000_000
_PRIOR = 1e-7
#: Words whose counts every worker holds; the rest are looked up by a join.
FREQUENT_WORDS = 150_000


def word_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class 1 to CLASSES - 1 of each word, by its length (up to 4) and last two bytes in lower case."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    length = ends - starts
    before = np.where(length > 1, low[np.maximum(ends - 2, 0)], np.uint64(0))
    key = (np.minimum(length, 4).astype(np.uint64) << np.uint64(16)) | before << np.uint64(8) | low[ends - 1]
    return (mix(key) % np.uint64(CLASSES - 1)).astype(np.int64) + 1


def token_stream(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all tokens (each text's words, then its end) and where each text's tokens begin."""
    begin = first + np.arange(len(first))
    tokens = np.full(len(classes) + len(first) - 1, END, dtype=np.int64)
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[begin[1:] - 1] = False
    tokens[is_word] = classes
    one = np.concatenate([[END], tokens[:-1]])
    two = np.concatenate([[END], one[:-1]])
    two[begin[:-1]] = END  # what precedes a text's first token belongs to the text before
    return (two * CLASSES + one) * CLASSES + tokens, begin


def _count(batches):
    """Rows (kind, key, class, n): counts of words (kind 0), of class trigrams (kind 1) and of the task's tokens (kind 2)."""
    from pyspark import TaskContext

    trigrams = np.zeros(CLASSES**3, dtype=np.int64)

    def rows(kind, key, cls, n):
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind, pa.int32()), len(key)), pa.array(key), pa.array(cls.astype(np.int32)), pa.array(n.astype(np.int64))],
                                          ["kind", "key", "cls", "n"])

    for batch in batches:
        words, classes, counts = [], [], []
        for _, data, offsets in text_slices(batch.column("text")):
            starts, ends, first = word_spans(data, offsets)
            cls = word_classes(data, starts, ends)
            trigrams += np.bincount(token_stream(cls, first)[0], minlength=len(trigrams))
            u, at, n = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
            words.append(u), classes.append(cls[at]), counts.append(n)
        if words:
            u, at, inverse = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
            yield rows(0, u.view(np.int64), np.concatenate(classes)[at], np.bincount(inverse, weights=np.concatenate(counts)))
    seen = np.flatnonzero(trigrams)
    yield rows(1, seen, np.zeros(len(seen)), trigrams[seen])
    yield rows(2, np.array([TaskContext.get().partitionId()]), np.zeros(1), trigrams.sum(keepdims=True))


def _sums(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sum of the rows of ``g`` at each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.add.reduceat(g[order], first, axis=0)


class LogBilinear:
    """score(c | a, b) = (two[a] + one[b]) . target[c] + bias[c]; a is a class, b and c are units, the first of which are the classes."""

    def __init__(self, trigrams: np.ndarray, counts: np.ndarray, classes: int = CLASSES, seed: int = 11, steps: int = STEPS):
        rng = np.random.default_rng(seed)
        unigram = np.bincount(trigrams % classes, weights=counts, minlength=classes) + 1.0
        self._noise(unigram / unigram.sum())
        self.p = {k: rng.normal(0, 0.1, (classes, DIM)).astype(np.float32) for k in ("two", "one", "target")} | {"bias": self.log_noise[:, None].copy()}
        if not len(trigrams):
            return
        self.begin(1e-8)
        cumulative = np.cumsum(counts / counts.sum())
        weight = np.ones(BATCH)
        for step in range(steps):
            drawn = trigrams[np.minimum(np.searchsorted(cumulative, rng.random(BATCH)), len(trigrams) - 1)]
            self.step(drawn // classes**2, drawn // classes % classes, drawn % classes, weight, rng, 0.15 / (1 + 3 * step / steps))
        self.grad2 = {}

    def _noise(self, noise: np.ndarray) -> None:
        self.falls, self.log_noise = np.cumsum(noise), np.log(noise).astype(np.float32)

    def begin(self, prior: float) -> None:
        """Forget past gradients."""
        self.grad2 = {k: np.full(v.shape, prior, dtype=np.float32) for k, v in self.p.items()}

    def widen(self, class_of: np.ndarray, unigram: np.ndarray) -> None:
        """Add units that start from the vectors of their classes; ``unigram`` has the counts of all units."""
        shift = self.p["bias"][:, 0] - self.log_noise
        self._noise((unigram + 1.0) / (unigram + 1.0).sum())
        for k in ("one", "target"):
            self.p[k] = np.concatenate([self.p[k], self.p[k][class_of]])
        self.p["bias"] = (self.log_noise + np.concatenate([shift, shift[class_of]]))[:, None]

    def step(self, two, one, hit, weight, rng, rate) -> None:
        """One minibatch of weighed data against shared noise; the loss is logistic in score - log(k * noise)."""
        p = self.p
        other = np.minimum(np.searchsorted(self.falls, rng.random(NOISE)), len(self.falls) - 1)
        weight = (weight / weight.sum()).astype(np.float32)
        context, target, noise = p["two"][two] + p["one"][one], p["target"][hit], p["target"][other]
        unlike = np.log(np.float32(NOISE)) + self.log_noise
        data = np.einsum("ij,ij->i", context, target) + p["bias"][hit, 0] - unlike[hit]
        data = -weight / (1 + np.exp(np.clip(data, -30, 30)))
        error = context @ noise.T
        error += p["bias"][other, 0] - unlike[other]
        np.clip(error, -30, 30, out=error)
        error = weight[:, None] / (1 + np.exp(-error))
        g_context = data[:, None] * target + error @ noise
        g_target = np.concatenate([np.column_stack([data[:, None] * context, data]), np.column_stack([error.T @ context, error.sum(0)])])
        at, g = _sums(np.concatenate([hit, other]), g_target)
        for k, at, g in (("target", at, g[:, :-1]), ("bias", at, g[:, -1:]), ("two", *_sums(two, g_context)), ("one", *_sums(one, g_context))):
            past = self.grad2[k][at] + g * g
            self.grad2[k][at] = past
            p[k][at] -= rate * g / np.sqrt(past)

    def log_totals(self, one: np.ndarray) -> np.ndarray:
        """The log of the sum of exp(score) over all units for every class two before and the units ``one``, a row a unit."""
        p = self.p
        out = np.empty((len(one), len(p["two"])), dtype=np.float32)
        target = np.hstack([p["target"], p["bias"]]).T
        context = np.ones((len(p["two"]), DIM + 1), dtype=np.float32)
        for i, b in enumerate(one):
            np.add(p["two"], p["one"][b], out=context[:, :DIM])
            score = context @ target
            top = score.max(axis=1)
            score -= top[:, None]
            out[i] = top + np.log(np.exp(score, out=score).sum(axis=1))
        return out

    def table(self) -> np.ndarray:
        """log10 P(c | a, b) for every trigram number, each context's row normalised."""
        p = self.p
        score = (p["two"][:, None, :] + p["one"][None, :, :]) @ p["target"].T + p["bias"][:, 0]
        score -= self.log_totals(np.arange(len(p["one"]))).T[:, :, None]
        return (score / np.log(10)).astype(np.float32).ravel()


def _contexts(units: np.ndarray, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens the class two before, the unit before and the unit, and where each text's tokens begin."""
    trigrams, begin = token_stream(classes, first)
    unit = np.full(len(trigrams), END, dtype=np.int64)
    is_word = np.ones(len(unit), dtype=bool)
    is_word[begin[1:] - 1] = False
    unit[is_word] = units
    return trigrams // CLASSES**2, np.concatenate([[END], unit[:-1]]), unit, begin


def _learn(model, part, parts, seed, rate, size):
    """Gradient steps over the slices of one part; rows (block, unit, how often met, vectors) of the units met."""
    def run(batches):
        from pyspark import TaskContext

        keys, lbl = model.value
        index, n = KeyIndex(keys), len(lbl.p["one"])
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        lbl = copy.copy(lbl)
        lbl.p = {k: v.copy() for k, v in lbl.p.items()}
        lbl.begin(_PRIOR * (BATCH / size)**2)
        met, slices = np.zeros((3, n)), TaskContext.get().partitionId()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column("text")):
                slices += 1
                if slices % parts != part:
                    continue
                starts, ends, first = word_spans(data, offsets)
                classes = word_classes(data, starts, ends)
                at = index.find(word_hashes(data, starts, ends).view(np.int64))
                two, one, hit, _ = _contexts(np.where(at >= 0, at + CLASSES, classes), classes, first)
                for m, x in zip(met, (two, one, hit)):
                    m += np.bincount(x, minlength=n)
                seen, times = np.unique((two * n + one) * n + hit, return_counts=True)
                order = rng.permutation(len(seen))
                for at in np.array_split(order, min(len(seen), -(-len(hit) // size))):
                    some = seen[at]
                    lbl.step(some // n**2, some // n % n, some % n, times[at], rng, rate)
        p, unit = lbl.p, np.flatnonzero(met.any(axis=0))
        two = np.zeros((n, DIM), dtype=np.float32)
        two[:CLASSES] = p["two"]
        values = np.hstack([met.T, two, p["one"], p["target"], p["bias"]])[unit].astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
        for lo in range(0, len(unit), 1000):
            some = slice(lo, lo + 1000)
            yield pa.RecordBatch.from_arrays([pa.array((unit[some] % 32).astype(np.int32)), pa.array(unit[some].astype(np.int32)), lists[some]], ["block", "unit", "v"])
    return run


def _average(table):
    """A row a unit: the tasks' vectors, each weighed by how often the task met the unit in that place."""
    flat = table.column("v").combine_chunks()
    values = flat.flatten().to_numpy().reshape(len(flat), -1).astype(np.float64)
    met = values[:, :3]
    times = np.repeat(met, [DIM, DIM, DIM + 1], axis=1)
    unit, total = _sums(table.column("unit").to_numpy(), np.hstack([met, values[:, 3:] * times]))
    total[:, 3:] /= np.maximum(np.repeat(total[:, :3], [DIM, DIM, DIM + 1], axis=1), 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.astype(np.float32).ravel()))
    return pa.table({"unit": pa.array(unit.astype(np.int32)), "v": lists})


def train(texts: DataFrame, lbl: LogBilinear, keys: np.ndarray, tokens: int, busiest: int) -> None:
    """Rounds of steps in all tasks at once; every token is in one round of each pass, and the largest task of ``busiest`` tokens
    steps over at most some ROUND_TOKENS in a round, so rounds grow with what a task holds."""
    spark = texts.sparkSession
    size = int(np.clip(tokens // 2000, 64, BATCH))  # small steps where there are few
    parts = max(2, -(-busiest // ROUND_TOKENS))
    rounds = PASSES * parts
    for k in range(rounds):
        model = spark.sparkContext.broadcast((keys, lbl))
        learned = texts.mapInArrow(_learn(model, k % parts, parts, k, 0.1 / (1 + 2 * k / rounds), size), "block int, unit int, v array<float>")
        got = learned.groupBy("block").applyInArrow(_average, "unit int, v array<float>").toArrow()  # a row a unit
        model.unpersist()
        if not len(got):
            continue
        unit = got.column("unit").to_numpy()
        v = got.column("v").combine_chunks().flatten().to_numpy().reshape(len(unit), -1)
        for name, place, lo, hi in (("two", 0, 3, 3 + DIM), ("one", 1, 3 + DIM, 3 + 2 * DIM), ("target", 2, 3 + 2 * DIM, 3 + 3 * DIM), ("bias", 2, 3 + 3 * DIM, 4 + 3 * DIM)):
            m = v[:, place] > 0
            lbl.p[name][unit[m]] = v[m, lo:hi]


def _totals(model):
    def run(batches):
        for batch in batches:
            unit = batch.column("id").to_numpy()
            out = model.value[1].log_totals(unit)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))], ["id", "v"])
    return run


def _score(model):
    def run(batches):
        from pyspark import TaskContext

        row_id = TaskContext.get().partitionId() << 40
        keys, counts, own, lbl, totals, spread = model.value
        p = lbl.p
        index = KeyIndex(keys)
        log_count = np.append(np.log10(counts + 1.0), 0.0)
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column("text")):
                rows = batch.slice(lo, len(offsets) - 1)
                starts, ends, first = word_spans(data, offsets)
                words = word_hashes(data, starts, ends).view(np.int64)
                classes = word_classes(data, starts, ends)
                at = index.find(words)
                mine = (at >= 0) & (at < own)
                two, one, hit, begin = _contexts(np.where(mine, at + CLASSES, classes), classes, first)
                bits = np.einsum("ij,ij->i", p["two"][two] + p["one"][one], p["target"][hit]) + p["bias"][hit, 0] - totals[one, two]
                lm = np.add.reduceat(bits.astype(np.float64), begin[:-1]) / np.log(10)

                def per_text(v):
                    total = np.concatenate([[0.0], np.cumsum(v)])
                    return total[first[1:]] - total[first[:-1]]

                known, logs, shares = per_text(at >= 0), per_text(log_count[at]), per_text(np.where(mine, log_count[at], spread[classes]))
                rare = np.flatnonzero(at < 0)
                text = np.searchsorted(first, rare, side="right") - 1
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(rows) + 1)).astype(np.int32)), pa.array(words[rare]))
                ids = np.arange(row_id, row_id + len(rows))
                row_id += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(begin)), pa.array(known.astype(np.int64)), pa.array(logs),
                     pa.array(lm - shares), lists], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "lm", "rare"])
    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learns from rows not ``held_out``.

    Tokens are the lower-cased words of the whole text, then one end. ``base_score`` is the add-one
    unigram log10 probability; ``score`` is the model's: for each token log10
    P(unit | unit before, class two before), for each word without vectors of its own also log10 of its add-one
    share among such words of its class, in which one share is left for all unknown words.
    Null and empty texts are one end token. Repeated rows count as often as they are there;
    an empty table gives an empty result, and with nothing to learn from
    every count is 0; other columns are ignored. Words go by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.where(~F.col("held_out")).select("text").mapInArrow(_count, "kind int, key long, cls int, n long")
    totals = staged(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.first("cls").alias("cls")), "counts")
    trigrams = totals.where("kind = 1").select("key", "n").orderBy("key").toArrow()  # at most CLASSES^3 rows
    words = totals.where("kind = 0").withColumn("bin", F.floor(F.log2("n") * 4).cast("int"))
    key, n = trigrams.column("key").to_numpy(), trigrams.column("n").to_numpy()
    ends = int(n[key % CLASSES == END].sum())
    # A row a class.
    classes = words.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    busiest = totals.where("kind = 2").agg(F.max("n")).first()[0] or 0
    train_tokens = ends + sum(r.n for r in classes)
    kinds = (ends > 0) + sum(r.v for r in classes)
    # The frequent words are those above the least count that leaves no more of them than a worker may hold.
    bins = {r.bin: r["count"] for r in words.groupBy("bin").count().collect()}  # a few hundred bins
    least, held = max(bins, default=0) + 1, 0
    while least - 1 >= 0 and held + bins.get(least - 1, 0) <= FREQUENT_WORDS:
        least -= 1
        held += bins.get(least, 0)
    top = words.where(F.col("bin") >= least).select("key", "n", "cls").toArrow()
    held_key, held_n, held_cls = (top.column(c).to_numpy() for c in ("key", "n", "cls"))
    order = np.lexsort((held_key, -held_n))
    held_key, held_n, held_cls = held_key[order], held_n[order], held_cls[order].astype(np.int64)
    own = int(np.searchsorted(-held_n[:OWN_WORDS], -LEAST_COUNT, side="right"))
    rare_n, rare_kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        rare_n[r.cls], rare_kinds[r.cls] = r.n, r.v
    rare_n -= np.bincount(held_cls[:own], weights=held_n[:own], minlength=CLASSES)
    rare_kinds -= np.bincount(held_cls[:own], minlength=CLASSES)
    spread = np.log10(rare_n + rare_kinds + 1)
    lbl = LogBilinear(key, n)
    rare_n[END] = ends
    lbl.widen(held_cls[:own], np.concatenate([rare_n, held_n[:own]]))
    if train_tokens:
        train(rows.where(~F.col("held_out")).select("text"), lbl, held_key[:own], train_tokens, busiest)
    model = spark.sparkContext.broadcast((held_key, lbl))
    found = spark.range(len(lbl.p["one"]), numPartitions=max(1, min(64, len(lbl.p["one"]) // 100))).mapInArrow(_totals(model), "id long, v array<float>").toArrow()
    model.unpersist()
    totals = np.empty((len(found), CLASSES), dtype=np.float32)
    totals[found.column("id").to_numpy()] = found.column("v").combine_chunks().flatten().to_numpy().reshape(len(found), -1)
    model = spark.sparkContext.broadcast((held_key, held_n, own, lbl, totals, spread))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = staged(rows.mapInArrow(_score(model), f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, lm double, rare array<long>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    looked = rare.join(words.where(F.col("bin") < least).select("key", "n"), "key").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    unit = float(np.log10(train_tokens + kinds + 1))
    return scored.drop("rare").join(looked, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (logs + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("lm") + logs).alias("score"))
