"""Toxicity: a counterfactual-regularised linear classifier over the words of a text.

Training, on a bounded sample of labelled rows (the SAMPLE rows first in order of a hash of doc_id):

1. Features are words, and word stems: "at least 1, 2, or 3 different words of the text begin with these 4 to 8 bytes".
   Two passes over the sample count, by class, in how many texts each occurs: first by 2**18 hash ranges, then exactly,
   for the ranges that tell the classes apart. The VOCABULARY features with the best G-test stay, and every identity term.
2. Counterfactuals. In each labelled sentence with an identity term, the term is swapped for every other term of its
   group; the change of the feature vector is kept with the pair.
3. Fit. Logistic loss, ridge, and PENALTY times the mean squared change of the logit over all counterfactual pairs, by
   Newton steps. So identity terms end up with equal weights, and as a group's neutral word is one of its terms, mentions
   of a group do not move a score.

Scores are 1 / (1 + exp(-logit)) of whole texts: words are letter runs in lower case, each counted once.

Cases: a null or empty text has no words and scores as the offset says; a null label or doc_id is not learned
from, of several labels of one doc_id the largest counts; without labels of both classes every score is the share of
label 1 (0 if there are none); repeated rows are each scored; empty tables work; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import held_out

SAMPLE = 10_000
RANGES = 1 << 18
OPEN_RANGES = 3000
VOCABULARY = 600
STEMS = range(4, 9)
TIMES = 3
LEAST_TEXTS = 4
PENALTY = 10.0
RIDGE = 1.0
# Identity terms by group; the first of each group is its neutral word.
IDENTITY = [
    "people men women man woman boys girls transgender nonbinary",
    "person gay lesbian bisexual straight queer homosexual heterosexual",
    "believers muslim muslims christian christians jewish jews hindu hindus buddhist buddhists catholic catholics atheist atheists",
    "citizens black white asian latino latina hispanic african european american arab mexican chinese indian immigrant immigrants refugee refugees",
    "adults old young elderly disabled blind deaf autistic",
]
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[10, 33, 46, 63]] = True


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    low, s, e, _ = common.letter_runs(raw, np.array([0, len(raw)]))
    return int(common.hash_spans(low, s, e)[0])


_TIMES = [np.uint64(0x9E3779B97F4A7C15 * (t + 1) % (1 << 64)) for t in range(TIMES)]


def _distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each different (hash, text), ordered by text, and how often it occurs."""
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    edge = np.flatnonzero(new)
    return order[edge], np.diff(np.append(edge, len(hs)))


def _words_of(data: np.ndarray, offs: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (feature, text) pairs of a slice, and every run's start and hash.

    With ``known``, sorted features, only those are made; a stem's count is part of its feature by exclusive or, so
    which stems matter can be read off.
    """
    low, s, e, first = common.letter_runs(data, offs)
    h = common.hash_spans(low, s, e)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    one, _ = _distinct(h, text)
    stems = None if known is None else np.unique(np.concatenate([known ^ t for t in _TIMES]))
    out, of = [h[one] if known is None else h[one][(keep := _locate(known, h[one])[0])]], [text[one] if known is None else text[one][keep]]
    with np.errstate(over="ignore"):
        for k in STEMS:
            own = one[e[one] - s[one] >= k]
            stem = common.hash_spans(low, s[own], s[own] + k) * np.uint64(2 * k + 1)
            if stems is not None:
                hit, _ = _locate(stems, stem)
                own, stem = own[hit], stem[hit]
            each, often = _distinct(stem, text[own])
            for t in range(TIMES):
                enough = each[often > t]
                out.append(stem[enough] ^ _TIMES[t])
                of.append(text[own][enough])
    return np.concatenate(out), np.concatenate(of), s, h


def _range_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, RANGES), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for i, _, data, offs in common.slices(batch, "text"):
            h, t, _, _ = _words_of(data, offs)
            bucket = (h >> np.uint64(46)).astype(np.int64)
            pair = np.unique(bucket + RANGES * t.astype(np.int64))
            for c in (0, 1):
                total[c] += np.bincount(pair[toxic[i + pair // RANGES] == c] % RANGES, minlength=RANGES)
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["word", "clean", "toxic"])


def _word_counts(open_ranges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(RANGES, bool)
        wanted[open_ranges] = True
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for i, _, data, offs in common.slices(batch, "text"):
                h, t, _, _ = _words_of(data, offs)
                keep = wanted[(h >> np.uint64(46)).astype(np.int64)]
                words, back = np.unique(h[keep], return_inverse=True)
                label = toxic[i + t[keep]]
                counts = [np.bincount(back[label == c], minlength=len(words)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["word", "clean", "toxic"])

    return run


def g_test(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The G statistic of word presence against label, with half a text added to each cell."""
    seen = np.stack([clean, toxic]) + 0.5
    rest = np.array([[n_clean], [n_toxic]]) - np.stack([clean, toxic]) + 0.5
    total = n_clean + n_toxic + 2.0
    row = np.array([[n_clean + 1.0], [n_toxic + 1.0]]) / total
    out = 0
    for cell in (seen, rest):
        out = out + 2 * (cell * np.log(cell / (row * cell.sum(axis=0)))).sum(axis=0)
    return out


def _locate(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are in the sorted words, and where."""
    at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
    hit = np.flatnonzero(words[at] == h) if len(words) else np.zeros(0, np.int64)
    return hit, at[hit]


def _vectors(words: np.ndarray, groups: list[np.ndarray]):
    """Feature numbers of each text, and for identity terms the changes that swaps in its sentences make."""
    group_of = np.full(len(words), -1)
    for g, members in enumerate(groups):
        group_of[members] = g

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, ids = batch.column(1), batch.column(2)
            for i, j, data, offs in common.slices(batch, "text"):
                h, t, s, every = _words_of(data, offs, words)
                hit, at = _locate(words, h)
                hit, at = hit[(order := np.argsort(t[hit], kind="stable"))], at[order]
                own, feature = t[hit], at
                # sentences of identity terms: the swap takes the term from this sentence and puts another there
                term, which = _locate(words, every)
                named = group_of[which] >= 0
                term, which = term[named], which[named]
                sentence = np.cumsum(_SENTENCE_END[data])[s[term]] if len(term) else np.zeros(0, np.int64)
                text = np.searchsorted(offs, s[term], side="right") - 1
                swaps: list[set] = [set() for _ in range(j - i)]
                for x, w, _ in sorted({(int(x), int(w), int(z)) for x, w, z in zip(text, which, sentence, strict=True)}):
                    swaps[x] |= {(w, int(v)) for v in groups[group_of[w]] if v != w}
                edge = np.searchsorted(own, np.arange(j - i + 1))
                features = [np.sort(feature[edge[k] : edge[k + 1]]).astype(np.int32) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([zlib.crc32(x.tobytes()) for x in features], pa.int64()), toxic.slice(i, j - i), pa.array(features, pa.list_(pa.int32())), pa.array([[v for pair in sorted(x) for v in pair] for x in swaps], pa.list_(pa.int32()))],
                    names=["id", "mark", "toxic", "features", "swaps"],
                )

    return run


def fit_weights(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, penalty: float = PENALTY, ridge: float = RIDGE) -> np.ndarray:
    """Newton's method on the regularised logistic loss; swaps are rows of feature changes; the last weight is the offset."""
    n, m = x.shape
    hold = np.diag(np.append(np.full(m, ridge), 1e-6))
    if len(swaps):
        d = np.concatenate([swaps, np.zeros((len(swaps), 1))], axis=1)
        hold = hold + penalty * n / len(d) * (d.T @ d)
    w = np.zeros(m + 1)

    def parts():
        """Rows with a column of ones, a block at a time, so that the wide form is never held whole."""
        for a in range(0, n, 1000):
            block = x[a : a + 1000]
            yield slice(a, a + len(block)), np.concatenate([block, np.ones((len(block), 1))], axis=1)

    def logits(v: np.ndarray) -> np.ndarray:
        return np.concatenate([block @ v for _, block in parts()]) if n else np.zeros(0)

    def loss(v: np.ndarray) -> float:
        z = logits(v)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * v @ hold @ v)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(logits(w), -30, 30)))
        curve, slope = hold.copy(), hold @ w
        for rows, block in parts():
            curve += (block * (p[rows] * (1 - p[rows]) + 1e-9)[:, None]).T @ block
            slope += block.T @ (p[rows] - y[rows])
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, gain, now = w - size * step, now - after, after
        if gain < 1e-9 * max(1.0, abs(now)):
            break
    return w


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, offset: float) -> None:
        order = np.argsort(words)
        self.words, self.weights, self.offset = words[order], weights[order], offset


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Fit on documents that labels (doc_id, toxic) marks 0 or 1; at most ``sample`` of them."""
    common.prepare(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = common.materialize(marked.withColumn("turn", F.xxhash64(F.col("id").cast("string"), F.lit(6))), "labels")
    # about twice the rows wanted pass, so what one task sorts does not grow with the input
    share = min(1.0, (2.0 * sample + 200) / max(1, marked.count()))
    marked = marked.where((F.col("turn") / 2.0**64 + 0.5) <= share).orderBy("turn", "id").limit(sample)
    marked = common.materialize(marked.select("id", "toxic"), "sample")
    # at most ``sample`` rows of two numbers, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), F.col("doc") == F.col("id")).select("text", "toxic", "id")
    rows = common.materialize(rows, "sample")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    summed = lambda df: df.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
    columns = "word long, clean long, toxic long"
    got = summed(rows.mapInArrow(_range_counts, columns)).toArrow()
    word, clean, toxic = (got[c].to_numpy() for c in ("word", "clean", "toxic"))
    best = np.sort(word[np.argsort(-g_test(clean, toxic, n0, n1), kind="stable")[:OPEN_RANGES]])
    got = summed(rows.mapInArrow(_word_counts(best), columns)).toArrow()
    word, clean, toxic = (got[c].to_numpy() for c in ("word", "clean", "toxic"))
    order = np.lexsort((word, -g_test(clean, toxic, n0, n1)))[:VOCABULARY]
    groups = [[word_hash(w) for w in line.split()] for line in IDENTITY]
    words = np.unique(np.concatenate([word[order].view(np.uint64), np.array([h for g in groups for h in g], np.uint64)]))
    members = [np.searchsorted(words, np.array(g, np.uint64)) for g in groups]
    got = rows.mapInArrow(_vectors(words, members), "id long, mark long, toxic int, features array<int>, swaps array<int>").toArrow()
    got = got.take(np.lexsort([got[c].to_numpy() for c in ("toxic", "mark", "id")]))  # one order, so that sums come out alike
    features, pairs = (got[c].combine_chunks() for c in ("features", "swaps"))
    x = np.zeros((got.num_rows, len(words)), np.uint8)
    x[np.repeat(np.arange(got.num_rows), np.diff(features.offsets.to_numpy())), features.flatten().to_numpy()] = 1
    changes = pairs.flatten().to_numpy().reshape(-1, 2)
    kinds, often = np.unique(changes, axis=0, return_counts=True)
    swaps = np.zeros((len(kinds), len(words)))
    swaps[np.arange(len(kinds)), kinds[:, 0]] -= 1
    swaps[np.arange(len(kinds)), kinds[:, 1]] += 1
    swaps *= np.sqrt(often / max(1, often.sum()) * max(1, len(kinds)))[:, None]
    w = fit_weights(x, got["toxic"].to_numpy().astype(float), swaps, penalty)
    return Model(words, w[:-1], float(w[-1]))


def scores(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, scores) of a batch's texts, slice by slice."""
    for i, j, data, offs in common.slices(batch, "text"):
        h, t, _, _ = _words_of(data, offs, model.words)
        hit, at = _locate(model.words, h)
        z = model.offset + np.bincount(t[hit], weights=model.weights[at], minlength=j - i)
        yield i, j, 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, p in scores(model, batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs, from whole texts."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")


def learned(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> Model:
    return fit(docs, labels.where(~held_out(F.col("doc_id"), parts, part)))


def judge(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of rows whose crc32(doc_id) mod parts is part are not learned from."""
    scored = score(docs, learned(docs, labels, parts, part))
    held: Column = held_out(F.col("doc_id"), parts, part)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more."""
    model = learned(docs, labels, parts, part)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        found = [p < 0.5 for _, _, p in scores(model, pa.RecordBatch.from_arrays([text], ["text"]))]
        return pa.array(np.concatenate([np.zeros(0, bool), *found]))

    return docs.where(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))
