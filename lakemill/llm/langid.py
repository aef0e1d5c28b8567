"""Language ID by hierarchical discrimination: the family first, then one-versus-one SVMs within it.

A text's features are byte n-grams (1 to 4 bytes, with word edges) and whole words of its letter runs, hashed to
DIMENSIONS and averaged over its runs. Linear machines score them, so a text's score is the mean of its words' scores,
and each distinct word of a slice is scored once. One linear support vector machine for each family against the others
picks the family; for each pair of languages of it another votes, ties by margin. With one family
or one language there is nothing to choose.

Training uses a bounded sample: SAMPLE rows, dealt evenly to all languages, of each at most PER_LANGUAGE, those that come first in order of
a hash of doc_id. A first count of rows by language says which hashes can be among them. Features are made on the executors; the
driver fits SAMPLE rows of DIMENSIONS numbers at most, however many languages there are. Every language that occurs is learned; over SAMPLE of
them are an error. A family of more than GROUP languages is dealt into groups of neighbouring codes, so machines grow with the languages and not with their square.

Cases: a null text or one without a letter is ``und`` with score 0; rows of null lang are not learned from; a null
doc_id is not held out and not learned from; repeated rows are each scored; with nothing to learn from
every row is ``und``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1 << 12
PER_LANGUAGE = 700
SAMPLE = 8000  # rows of all languages together; each gets an equal part, PER_LANGUAGE at most
GROUP = 16  # a family of more languages is dealt into groups of so many
# Language codes by family; codes not listed form one family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky tt",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr gu pa ne si",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def word_features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of the given words."""
    size = ends - starts
    upto = np.cumsum(size + 2)
    base = upto - size - 2
    text = np.zeros(int(upto[-1]) if len(upto) else 0, np.uint64)  # each word between two edges
    body = np.repeat(starts - base - 1, size + 2) + np.arange(len(text))
    inner = np.ones(len(text), bool)
    inner[base] = inner[upto - 1] = False
    text[inner] = low[body[inner]].astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(starts)), size + 2)
    out, of = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(text), np.uint64)
        for n in range(1, 5):
            if len(text) < n:
                break
            h = h[: len(text) - n + 1] * np.uint64(257) + text[n - 1 :]
            ok = word[: len(h)] == word[n - 1 :]
            if n == 1:
                ok = ok & inner
            out.append(common.mix(h[ok] + np.uint64(n << 40)))
            of.append(word[: len(h)][ok])
        out.append(common.mix(common.hash_spans(low, starts, ends) + np.uint64(7)))
        of.append(np.arange(len(starts)))
    return (np.concatenate(out) % np.uint64(DIMENSIONS)).astype(np.int64), np.concatenate(of)


def _distinct(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, one, back = np.unique(common.hash_spans(low, starts, ends), return_index=True, return_inverse=True)
    return one, back


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in common.slices(batch, "text"):
            low, s, e, first = common.letter_runs(data, offs)
            one, back = _distinct(low, s, e)
            feature, word = word_features(low, s[one], e[one])
            edges = np.searchsorted(word[(order := np.argsort(word, kind="stable"))], np.arange(len(one) + 1))
            feature = feature[order]
            out = []
            for t in range(j - i):
                own = back[first[t] : first[t + 1]]
                size = edges[own + 1] - edges[own]
                flat = feature[np.repeat(edges[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                out.append((np.bincount(flat, minlength=DIMENSIONS) / max(1, len(own))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([zlib.crc32(v) for v in out], pa.int64()), pa.array(out, pa.binary())], names=["lang", "mark", "x"])


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """A linear SVM (squared hinge loss, classes weighed alike) by accelerated gradient steps; the last weight is the offset."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        v = x.T @ (cost * (x @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1.0 / (2 * top + penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - step * (penalty * ahead - 2 * (x.T @ (cost * y * slack)))
        ahead, w = after + k / (k + 3) * (after - w), after
    return w


class Model:
    """Weights of all machines side by side, and which families and languages each one decides between."""

    def __init__(self, langs: list[str], x: np.ndarray, lang: np.ndarray) -> None:
        self.langs = sorted(langs)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(DIMENSIONS, np.float32)
        self.scale = 1 / (x.std(axis=0) + 0.02) if len(x) else np.ones(DIMENSIONS, np.float32)
        x = ((x - self.mean) * self.scale / np.sqrt(DIMENSIONS)).astype(np.float32)
        family = {c: _FAMILY.get(c, "other") for c in self.langs}
        for name in set(family.values()):
            members = [c for c in self.langs if family[c] == name]
            if len(members) > GROUP:
                family |= {c: f"{name} {k // GROUP}" for k, c in enumerate(members)}
        self.families = sorted(set(family.values()))
        self.members = [[k for k, c in enumerate(self.langs) if family[c] == f] for f in self.families]
        of = np.array([family[c] for c in lang])
        machines = []
        if len(self.families) > 1:
            machines += [fit_svm(x, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in self.families]
        self.pairs: list[list[tuple[int, int, int]]] = []
        for group in self.members:
            own = []
            for a, b in combinations(group, 2):
                mine = (lang == self.langs[a]) | (lang == self.langs[b])
                own.append((a, b, len(machines)))
                machines.append(fit_svm(x[mine], np.where(lang[mine] == self.langs[a], 1.0, -1.0).astype(np.float32)))
            self.pairs.append(own)
        w = np.array(machines, np.float32).reshape(len(machines), DIMENSIONS + 1).T
        self.weights = w[:-1] * (self.scale / np.sqrt(DIMENSIONS))[:, None]
        self.offset = w[-1] - self.mean @ self.weights
        del self.mean, self.scale

    def choose(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores for rows of machine outputs."""
        n = len(margins)
        sure = lambda m: 1 / (1 + np.exp(-2.0 * np.clip(m, -20, 20)))
        if len(self.families) > 1:
            part = margins[:, : len(self.families)]
            pick = part.argmax(axis=1)
            score = sure(part.max(axis=1))
        else:
            pick, score = np.zeros(n, np.int64), np.ones(n)
        lang = np.zeros(n, np.int64)
        for f, (group, pairs) in enumerate(zip(self.members, self.pairs, strict=True)):
            rows = np.flatnonzero(pick == f)
            votes = np.zeros((len(rows), len(self.langs)))
            for a, b, k in pairs:
                m = margins[rows, k]
                votes[:, a] += (m >= 0) + np.tanh(m) * 1e-3
                votes[:, b] += (m < 0) - np.tanh(m) * 1e-3
            best = np.array(group)[votes[:, group].argmax(axis=1)] if len(rows) else np.zeros(0, np.int64)
            lang[rows] = best
            low = np.ones(len(rows))
            for a, b, k in pairs:
                m = margins[rows, k]
                low = np.where(best == a, np.minimum(low, sure(m)), np.where(best == b, np.minimum(low, sure(-m)), low))
            score[rows] *= low
        return lang, score


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows of docs (text, lang) for which learn holds, at most per_language of each."""
    common.prepare(docs.sparkSession)
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(8)).alias("h"))
    counts = rows.groupBy("lang").count().limit(SAMPLE + 1).collect()
    if len(counts) > SAMPLE:
        raise ValueError(f"over {SAMPLE} languages")
    per_language = min(per_language, SAMPLE // max(1, len(counts)))
    # about twice the rows wanted pass, so what one task sorts does not grow with the input
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * per_language + 50) / r["count"])) for r in counts], "lang string, share double")
    rows = rows.join(F.broadcast(shares), "lang").where((F.col("h") / 2.0**64 + 0.5) <= F.col("share"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= per_language)
    got = rows.select("lang", "text").mapInArrow(_features, "lang string, mark long, x binary").toArrow().sort_by([("lang", "ascending"), ("mark", "ascending")])
    lang = np.array(got["lang"].to_pylist(), object)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), "<f4").reshape(len(lang), DIMENSIONS)
    return Model(sorted(set(lang)), x, lang)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in common.slices(batch, "text"):
                low, s, e, first = common.letter_runs(data, offs)
                one, back = _distinct(low, s, e)
                k = model.weights.shape[1]
                each = np.zeros((len(one), k))
                for a in range(0, len(one), 20000):  # bounded: features of so many words at a time
                    feature, word = word_features(low, s[one[a : a + 20000]], e[one[a : a + 20000]])
                    for c in range(k):
                        each[a : a + 20000, c] = np.bincount(word, weights=model.weights[feature, c], minlength=len(one[a : a + 20000]))
                run_of = np.repeat(np.arange(j - i), np.diff(first))
                margins = np.stack([np.bincount(run_of, weights=each[back, c], minlength=j - i) for c in range(k)], axis=1) if k else np.zeros((j - i, 0))
                margins = margins / np.maximum(1, np.diff(first))[:, None] + model.offset
                lang, score = model.choose(margins)
                text = batch.column(2).slice(i, j - i)
                known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                names = [model.langs[x] if ok and model.langs else "und" for x, ok in zip(lang, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.where(known & bool(model.langs), score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, held: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod parts is not part, and predict all rows."""
    held = held_out(F.col("doc_id"), parts, part)
    return predict(docs, fit(docs, ~held & F.col("doc_id").isNotNull()), held)
