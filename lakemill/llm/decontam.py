"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. One pass counts, over all documents, in how many each word n-gram (n = SEED = 2) of the benchmark occurs. Only the
   benchmark's own n-grams leave the scan, already summed by slice.
2. An alignment of score S, with m matches and e = m - S edits at most, holds at least m - (e + 1) = S - 1 intact pairs of
   words. So a copy of score T or more hits T - 1 pairs of the item within 2 * words - T words of text, whatever
   is edited. Seeds are the item's pairs, rarest first: the most frequent ones are left out, up to half of T - 1 places, and
   each place left out lowers the number of hits asked for by one. So no copy is lost by it.
3. A second pass looks the seeds up in every whole document. Where enough hits of one item stand near enough, the words that an alignment
   through them can reach are aligned to the item by Smith-Waterman over words (match +1, mismatch and gap -1 each).
4. A document is contaminated by an item if the alignment's score reaches SHARE of the item's words and at
   least min(LEAST, words of the item) of them match.

The benchmark is the stated query set. It is read in blocks of at most BLOCK_BYTES of text, whose tables go to
the tasks; documents are only scanned, never shuffled.

Cases: words are folded to lower case (ASCII) and stripped of punctuation at their ends, a word of punctuation
stays as it is; null or empty texts and items match nothing; an item of
fewer than ``shortest`` = N words is no evidence inside a longer text and matches only a text of just its words; equal items each report; repeated document rows each report; several copies of an item in one document
are one row, that of the best score; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N = 4
SEED = 2
SHARE = 0.4
LEAST = 8
BLOCK_BYTES = 8 << 20
HITS = 1 << 22  # hits held at once, but for a single text
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def folded_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of each text, and each text's first word."""
    low = _LOWER[data]
    starts, ends, first = common.spans_of_words(low, offs)
    s, e = starts.copy(), ends.copy()
    live = np.arange(len(s))
    while len(live):
        live = live[(s[live] < e[live] - 1) & _PUNCT[low[e[live] - 1]]]
        e[live] -= 1
    live = np.arange(len(s))
    while len(live):
        live = live[(s[live] < e[live] - 1) & _PUNCT[low[s[live]]]]
        s[live] += 1
    return common.hash_spans(low, s, e), first


class Items:
    """A block of the benchmark: words of each item and a sorted table of the n-grams of items of N words or more."""

    def __init__(self, rows: list[tuple[int | None, str | None]], shortest: int = N) -> None:
        self.shortest = shortest
        self.ids = [r[0] for r in rows]
        raw = [(r[1] or "").encode() for r in rows]
        offs = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.words, self.first = folded_words(data, offs)
        self.size = np.diff(self.first)
        grams, at = common.ngrams(self.words, self.first, SEED)
        item = np.searchsorted(self.first, at, side="right") - 1
        long = self.size[item] >= max(SEED, shortest)  # a text shorter than a pair has its words as one n-gram, which is no pair
        self.grams, self.item = grams[long], item[long]
        self.keys = np.unique(self.grams)
        self.vocabulary = np.unique(self.words)
        self.short: dict[tuple, list[int]] = defaultdict(list)
        for k in np.flatnonzero((self.size > 0) & (self.size < shortest)).tolist():
            self.short[tuple(self.of(k).tolist())].append(k)

    def of(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]

    def seeds(self, counts: dict[int, int], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n-gram, item) of the seeds, sorted by n-gram; for each item the hits that a copy has at least, and the words it spans at most."""
        least = np.ceil(share * self.size - 1e-9).astype(np.int64)
        need, span = least - 1, 2 * self.size - least
        order = np.lexsort((self.grams, self.item))
        grams, item = self.grams[order], self.item[order]
        start = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (item[1:] != item[:-1]))) if len(grams) else order
        places = np.diff(np.append(start, len(grams)))
        grams, item = grams[start], item[start]
        often = np.array([counts.get(g, 0) for g in grams.view(np.int64).tolist()], np.int64)
        kept = np.ones(len(grams), bool)
        spare = need // 2
        for k in np.lexsort((-often, item)).tolist():  # each item's most frequent first
            i = item[k]
            if often[k] and places[k] <= spare[i]:
                kept[k] = False
                spare[i] -= places[k]
                need[i] -= places[k]
        grams, item = grams[kept], item[kept]
        order = np.argsort(grams, kind="stable")
        return grams[order], item[order], need, span


def _lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left ends and right ends in sorted keys for those values that occur in it; the values' positions first."""
    left = np.searchsorted(keys, values, side="left")
    hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == values) if len(keys) else np.zeros(0, np.int64)
    return hit, left[hit]


def _scan(words: np.ndarray, first: np.ndarray, keys: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of texts that are in keys: key position, text, first word. Words outside the vocabulary rule most places out."""
    known = np.zeros(len(words) + SEED, np.int32)
    hit, _ = _lookup(vocabulary, words)
    known[hit] = 1
    run = np.concatenate([[0], np.cumsum(known)])
    count = np.diff(first)
    end = np.repeat(first[1:], count)
    at = np.arange(len(words))
    stop = np.minimum(at + SEED, end)
    at = at[(stop - at == SEED) & (run[stop] - run[at] == SEED)]
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for k in range(SEED):
            h = h * np.uint64(common._P) + words[at + k]
        h = common.mix(h)
    hit, where = _lookup(keys, h)
    return where, np.searchsorted(first, at[hit], side="right") - 1, at[hit]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (score, matches, first word, end word) of the best local alignment."""
    n, m = len(item), len(text)
    if not n or not m:
        return 0, 0, 0, 0
    table = np.zeros((n + 1, m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(table[i - 1] - 1, 0)
        row[1:] = np.maximum(row[1:], table[i - 1, :-1] + np.where(text == item[i - 1], 1, -1))
        table[i] = np.maximum.accumulate(row + ramp) - ramp  # gaps along the text
    score = int(table.max())
    i, j = (int(x) for x in np.unravel_index(int(table.argmax()), table.shape))
    end, matches = j, 0
    while i and j and table[i, j] > 0:
        same = text[j - 1] == item[i - 1]
        if table[i, j] == table[i - 1, j - 1] + (1 if same else -1):
            matches += int(same)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matches, j, end


def _counter(items: Items):
    keys, vocabulary = items.keys, items.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, _, data, offs in common.slices(batch, "text"):
                words, first = folded_words(data, offs)
                where, text, _ = _scan(words, first, keys, vocabulary)
                pair = np.unique(np.stack([where, text]), axis=1) if len(where) else np.zeros((2, 0), np.int64)
                total += np.bincount(pair[0], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], names=["gram", "n"])

    return run


def _finder(items: Items, seeds: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], share: float, least: int):
    grams, owner, need, span = seeds
    keys = np.unique(grams)
    left, right = np.searchsorted(grams, keys, "left"), np.searchsorted(grams, keys, "right")
    free = np.flatnonzero((items.size >= max(1, items.shortest)) & (need < 1)).tolist()  # a low share asks for no intact pair: aligned to every text

    def near(where: np.ndarray, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end word) of each stretch that holds the hits of a copy."""
        many = right[where] - left[where]
        spot = np.repeat(left[where] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        text, at, item = np.repeat(text, many), np.repeat(at, many), owner[spot]
        held = np.flatnonzero(need[item] > 0)
        text, at, item = text[held], at[held], item[held]
        order = np.lexsort((at, item, text))
        text, at, item = text[order], at[order], item[order]
        mine = np.arange(len(text))
        last = mine + need[item] - 1
        mine = mine[last < len(text)]
        last = last[mine]
        good = (text[last] == text[mine]) & (item[last] == item[mine]) & (at[last] - at[mine] <= span[item[mine]] - SEED)
        mine, last = mine[good], last[good]
        text, item, lo, hi = text[mine], item[mine], at[last] + SEED - span[item[mine]], at[mine] + span[item[mine]]
        cut = np.ones(len(text), bool)
        cut[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
        edge = np.append(np.flatnonzero(cut), len(text))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield int(text[a]), int(item[a]), int(lo[a]), int(hi[b - 1])

    def candidates(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        where, text, at = _scan(words, first, keys, items.vocabulary)
        upto = np.cumsum(right[where] - left[where])
        a = 0
        while a < len(where):  # whole texts, of about HITS hits together
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right"))
            b = len(where) if b >= len(where) else max(int(np.searchsorted(text, text[b])), int(np.searchsorted(text, text[a], "right")))
            yield from near(where[a:b], text[a:b], at[a:b])
            a = b
        for t in range(len(first) - 1) if free else ():
            yield from ((t, k, int(first[t]), int(first[t + 1])) for k in free)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(0)
            for i, _, data, offs in common.slices(batch, "text"):
                words, first = folded_words(data, offs)
                best: dict[tuple[int, int], tuple] = defaultdict(tuple)
                for t, k, lo, hi in candidates(words, first):
                    item, wide = items.of(k), int(span[k])
                    lo, hi = max(int(first[t]), lo), min(int(first[t + 1]), hi)
                    # a long stretch in pieces that overlap by what a copy spans
                    for a in range(lo, max(lo + 1, hi - wide), 7 * wide):
                        score, matches, x, y = align(item, words[a : min(hi, a + 8 * wide)])
                        if score >= share * len(item) and matches >= min(least, len(item)):
                            best[t, k] = max(best[t, k], (score, matches, -(a + x - int(first[t])), a + y - int(first[t]), len(item)))
                size = np.diff(first)
                for t in np.flatnonzero((size > 0) & (size < items.shortest)).tolist() if items.short else ():
                    for k in items.short.get(tuple(words[first[t] : first[t + 1]].tolist()), ()):
                        best[t, k] = (int(size[t]), int(size[t]), 0, int(size[t]), int(size[t]))
                rows += [(ids[i + t].as_py(), items.ids[k], *v) for (t, k), v in best.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] / r[6] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([-r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())],
                names=["doc_id", "item_id", "score", "n_matched", "first_word", "end_word"],
            )

    return run


def _blocks(benchmark: DataFrame, shortest: int) -> Iterator[Items]:
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_BYTES:
            yield Items(rows, shortest)
            rows, size = [], 0
    if rows:
        yield Items(rows, shortest)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST, shortest: int = N) -> DataFrame:
    """(doc_id, item_id, score, n_matched, first_word, end_word): a row for each document and item that it holds.

    Items of fewer than ``shortest`` words match whole texts only; with 1 all are looked for inside texts too.
    """
    common.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, n_matched int, first_word long, end_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, shortest):
        counted = texts.mapInArrow(_counter(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = {r["gram"]: r["n"] for r in counted.collect()}  # at most the block's own n-grams
        if len(items.words):
            found = found.unionByName(texts.mapInArrow(_finder(items, items.seeds(counts, share), share, least), schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST, shortest: int = N) -> DataFrame:
    """docs without the rows whose doc_id has a leak; a null doc_id is matched by null."""
    (key,) = common.unused(docs, "bad")
    bad = leaks(docs, benchmark, share, least, shortest).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")
