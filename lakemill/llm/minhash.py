"""MinHash near-dedup with BagMinHash signatures.

A text is the bag (multiset) of its five-word shingles. For each shingle of weight w there is one
Poisson process for each dyadic weight interval [0,1), [1,2), [2,4), ... that starts below w; its rate is the interval's
width, and each point carries a position in the interval and one of M components. A point counts if
its position lies below w: the bits of the position are the successive halvings of the interval, so only
as many processes run as w has binary digits. The signature holds the earliest point of each component, and two texts
agree in a component with probability equal to their weighted Jaccard similarity. Points are functions of (shingle,
interval, number) only, so any two workers agree.

Bands of the signature give buckets. Texts that share a bucket are candidates; those whose sketches
(a byte of each component) come nowhere near the threshold are put aside, with a margin of over five
standard deviations, and the rest are verified on the texts' exact bags. Verification goes first to each text's best
link to the leader of one of its buckets. Texts whose buckets still hold several classes are then
compared by a prefix filter, which lists no bucket's pairs and loses no link between different classes of them: two bags that reach
the threshold must share one of the first shingles in a global order from rare to common, early enough that both have
the weight left that the threshold asks for. Classes are connected components.

Cases: texts that are null or have no word are classes of their own, even when equal; texts of 1 to 4
words are one shingle; equal texts are one node however many rows hold them; the class id is the
least doc_id of its rows (null only if all are null); rows are kept one for one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6  # at 0.8: a pair is missed with probability 0.00006
FAN = 256
RANGES = 1 << 18
MARGIN = 0.16  # of the sketch estimate; its standard deviation at 0.8 is 0.029
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def signatures(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """The n x m point identities of n bags; shingles of one owner are distinct. Owners without shingles get zeros."""
    out = np.zeros((n, m), np.uint64)
    total = np.bincount(owner, weights=weights, minlength=n)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = m * (np.log(m) + 3.0) / total[todo]
    digits = np.where(weights > 0, np.floor(np.log2(np.maximum(weights, 1))).astype(np.int64) + (np.log2(np.maximum(weights, 1)) % 1 > 0) + 1, 0)
    unit = np.repeat(np.arange(len(shingles)), digits)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(digits) - digits, digits)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    keep = low < weights[unit]
    unit, level, low = unit[keep], level[keep], low[keep]
    with np.errstate(over="ignore"):
        seed = common.mix(shingles[unit] ^ ((level.astype(np.uint64) + np.uint64(1)) * _M1))
    width, own, weight = np.where(level == 0, 1.0, low), owner[unit], weights[unit]
    while len(todo):
        mine = np.zeros(n, bool)
        mine[todo] = True
        live = np.flatnonzero(mine[own])
        best = np.full(n * m, np.inf)
        times, slots, names = [], [], []
        at, k = np.zeros(len(live)), 0
        while len(live):
            k += 1
            with np.errstate(over="ignore"):
                point = common.mix(seed[live] + np.uint64(k) * _M2)
                place = common.mix(point ^ _M1)
            at = at - np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[live]
            ok = at <= reach[own[live]]
            live, at, point, place = live[ok], at[ok], point[ok], place[ok]
            inside = low[live] + width[live] * ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32) < weight[live]
            slot = own[live] * m + ((place & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            times.append(at[inside])
            slots.append(slot[inside])
            names.append(point[inside])
        t, s, p = (np.concatenate(x) if x else np.zeros(0) for x in (times, slots, names))
        s = s.astype(np.int64)
        np.minimum.at(best, s, t)
        win = t == best[s]
        flat = out.reshape(-1)
        flat[s[win]] = p[win].astype(np.uint64)
        full = np.isfinite(best.reshape(n, m)).all(axis=1)
        todo = todo[~full[todo]]
        reach[todo] *= 2.0
    return out


def bags(data: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a slice, their counts, and the text each belongs to."""
    starts, ends, first = common.spans_of_words(data, offs)
    grams, at = common.ngrams(common.hash_spans(data, starts, ends), first, size)
    owner = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    edge = np.flatnonzero(new)
    counts = np.diff(np.append(edge, len(grams)))
    return grams[edge], counts, owner[edge]


def _sign(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in common.slices(batch, "text"):
                grams, counts, owner = bags(data, offs, size)
                signed = signatures(grams, counts.astype(np.float64), owner, j - i, bands * rows)
                some = np.bincount(owner, minlength=j - i) > 0
                with np.errstate(over="ignore"):
                    keys = np.zeros((j - i, bands), np.uint64)
                    for r in range(rows):
                        keys = common.mix(keys * _M1 + signed[:, r::rows] + np.uint64(1))
                    keys = common.mix(keys + np.arange(bands, dtype=np.uint64) * _M2)
                sketch = (signed & np.uint64(0xFF)).astype(np.uint8)
                flat = pa.array(keys[some].reshape(-1).view(np.int64))
                at = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), flat), pa.array([x.tobytes() if y else None for x, y in zip(sketch, some, strict=True)], pa.binary())],
                    names=["node", "doc_id", "bands", "sketch"],
                )

    return run


def _near(m: int, floor: float):
    """Keep pairs whose sketches agree in about so many components; equal bytes by chance are taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, m) for k in (2, 3))
            likely = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = likely >= floor
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(likely[keep])], names=["a", "b", "likely"])

    return run


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    return both / max(1, int(x[1].sum() + y[1].sum()) - both)


def _verify(size: int, threshold: float):
    """Rows (a, b, text) in order: the text of a, with null b, stands before the texts of the b that it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            alone = batch.column(1).is_null().to_pylist()
            at, found = [], []
            for i, j, data, offs in common.slices(batch, "text"):
                grams, counts, owner = bags(data, offs, size)
                edge = np.searchsorted(owner, np.arange(j - i + 1)).tolist()
                for k in range(j - i):
                    own = grams[edge[k] : edge[k + 1]], counts[edge[k] : edge[k + 1]]
                    if alone[i + k]:
                        mine = own[0].copy(), own[1].copy()
                    elif (score := overlap(mine, own)) >= threshold:
                        at.append(i + k)
                        found.append(score)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return run


def _range_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RANGES, np.int64)
        for batch in batches:
            for _, _, data, offs in common.slices(batch, "text"):
                total += np.bincount((bags(data, offs, size)[0] >> np.uint64(46)).astype(np.int64), minlength=RANGES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["range", "n"])

    return run


def _prefixes(counts: np.ndarray, size: int, threshold: float):
    """Of each bag the shingles that come first in order of (count of hash range, hash), up to the weight that may be lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in common.slices(batch, "text"):
                grams, weights, owner = bags(data, offs, size)
                total = np.bincount(owner, weights=weights, minlength=j - i).astype(np.int64)
                order = np.lexsort((grams, counts[(grams >> np.uint64(46)).astype(np.int64)], owner))
                grams, weights, owner = grams[order], weights[order], owner[order]
                upto = np.cumsum(weights)
                before = upto - weights - np.concatenate([[0], np.cumsum(total)])[owner]
                keep = before <= total[owner] - np.ceil(threshold * total[owner] - 1e-9)
                short = before <= total[owner] - np.ceil(2 * threshold / (1 + threshold) * total[owner] - 1e-9)
                row = pa.array(owner[keep] + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(total[owner[keep]]), pa.array(before[keep]), pa.array(short[keep]), pa.array(grams[keep].view(np.int64))], names=["node", "class", "total", "before", "short", "gram"])

    return run


def _by_prefix(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, class, text) of different classes whose bags can be so similar."""
    # a table of at most RANGES counts; it decides the order only, not what is found
    got = nodes.mapInArrow(_range_counts(size), "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(RANGES, np.int64)
    counts[got["range"].to_numpy()] = got["n"].to_numpy()
    rows = common.materialize(nodes.select("node", "class", "text").mapInArrow(_prefixes(counts, size, threshold), "node string, class string, total long, before long, short boolean, gram long"), "prefixes")
    # sizes of two bags that reach the threshold lie in one band or in neighbours, so others never meet, whatever shingle they share
    band = F.floor(F.log(F.col("total").cast("double")) / float(np.log(1.001 / threshold))).cast("int")
    x = rows.where("short").select("gram", band.alias("band"), F.col("node").alias("a"), F.col("class").alias("p"), F.col("total").alias("s"), (F.col("total") - F.col("before")).alias("u"))
    y = rows.select("gram", F.explode(F.array(band, band - 1)).alias("band"), F.col("node").alias("b"), F.col("class").alias("q"), F.col("total").alias("t"), (F.col("total") - F.col("before")).alias("v"))
    # a shingle that many bags start with is dealt over as many tasks as FAN of them need
    turns = common.materialize(x.groupBy("gram", "band").agg(F.ceil(F.count("*") / FAN).cast("int").alias("turns")).where("turns > 1"), "turns")
    turn = F.coalesce("turns", F.lit(1))
    x = x.join(turns, ["gram", "band"], "left").withColumn("turn", F.pmod(F.xxhash64("a"), turn).cast("int")).drop("turns")
    y = y.join(turns, ["gram", "band"], "left").withColumn("turn", F.explode(F.sequence(F.lit(0), turn - 1))).drop("turns")
    # the smaller bag looks among its first shingles; from the first shared one on, enough weight must be left in both
    smaller = (F.col("s") < F.col("t")) | ((F.col("s") == F.col("t")) & (F.col("a") < F.col("b")))
    enough = F.least("u", "v") >= (F.col("s") + F.col("t")) * (threshold / (1 + threshold)) - 1e-6
    found = x.join(y, ["gram", "band", "turn"]).where(smaller & enough & (F.col("p") != F.col("q")) & (F.col("s") >= F.col("t") * threshold - 1e-6))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row's node, and a class for every node that is linked to another."""
    spark = docs.sparkSession
    common.prepare(spark)
    m = bands * rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.md5(text.cast("binary")).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    signed = common.materialize(base.mapInArrow(_sign(size, bands, rows), "node string, doc_id long, bands array<long>, sketch binary"), "signed")
    nodes = signed.where("sketch is not null").groupBy("node").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("s"))
    nodes = common.materialize(nodes.select("node", F.col("s.doc_id").alias("rep"), "s.bands", "s.sketch"), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    member = common.materialize(buckets.join(shared, "bucket"), "members")
    # a bucket's leader is the text that shares the most buckets with the most texts: that from which the others were copied
    central = member.groupBy("node").agg(F.sum("n").alias("reach"))
    leader = member.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("reach", "node")).alias("leader"))
    member = common.materialize(member.join(leader, "bucket").select("bucket", "node", "leader"), "members")

    sketches = nodes.select("node", "sketch")
    near = _near(m, threshold - MARGIN)

    def estimated(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
        return pairs.select("a", "b", "x", "y").mapInArrow(near, "a string, b string, likely double")

    # the texts of nodes that share a bucket, one row for each
    wanted = member.select("node").distinct().join(nodes.select("node", "rep"), "node")
    held = base.select("node", F.col("doc_id").alias("rep0"), "text").join(wanted, "node").where(F.col("rep0").eqNullSafe(F.col("rep")))
    held = common.materialize(held.select("node", "text").dropDuplicates(["node"]), "held")

    def verified(pairs: DataFrame) -> DataFrame:
        """Each a's text is sent once for every FAN of its partners, dealt by a turn, so that no text is one task's whole work."""
        pairs = common.materialize(pairs, "pairs")
        turns = common.materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("turns")), "turns")
        own = pairs.join(turns, "a").select("a", F.pmod(F.xxhash64("b"), F.col("turns")).cast("int").alias("turn"), "b")
        own = own.join(held.select(F.col("node").alias("b"), "text"), "b").select("a", "turn", "b", "text")
        lead = turns.select("a", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(None).cast("string").alias("b"))
        lead = lead.join(held.select(F.col("node").alias("a"), "text"), "a").select("a", "turn", "b", "text")
        dealt = own.unionByName(lead).repartition("a", "turn").sortWithinPartitions("a", "turn", F.col("b").asc_nulls_first())
        return dealt.select("a", "b", "text").mapInArrow(_verify(size, threshold), "a string, b string, similarity double")

    first = estimated(member.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    best = first.groupBy("b").agg(F.max_by("a", F.struct("likely", "a")).alias("a")).select("a", "b")
    one = common.materialize(verified(best), "links")
    classes = graph.components(one)
    # what is left: texts of buckets that hold several classes, and all pairs of them that can reach the threshold
    at = common.materialize(member.join(classes.select("node", "component"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("class")), "left")
    mixed = at.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket")
    open_ = at.join(mixed, "bucket", "left_semi").select("node", "class").distinct()
    rest = _by_prefix(common.materialize(open_.join(held, "node"), "open"), size, threshold)
    done = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    two = verified(estimated(rest.join(done, ["a", "b"], "left_anti")).select("a", "b"))
    every = one.unionByName(two).select("a", "b")
    return signed.select("node", "doc_id", F.col("sketch").isNotNull().alias("known")), graph.components(every)


def _classed(docs: DataFrame, threshold: float, size: int, bands: int, rows: int) -> DataFrame:
    """node, doc_id, known and class of each row."""
    each, linked = links(docs, threshold, size, bands, rows)
    alone = F.when(F.col("known"), F.col("node")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    each = each.withColumn("alone", alone).join(linked, "node", "left")
    return common.materialize(each.select("node", "doc_id", "known", F.coalesce("component", "alone").alias("class")), "classed")


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size): a row for each row of docs; class_id is the class's least doc_id."""
    each = _classed(docs, threshold, size, bands, rows)
    # written, so that the join back is one whose skewed partitions can be split
    named = common.materialize(each.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "named")
    return each.join(named, "class").select("doc_id", "class_id", "class_size")


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that of the least doc_id; rows without words all stay."""
    each = _classed(docs, threshold, WORDS, BANDS, ROWS).where("known")
    row = lambda node: F.concat(node, F.lit(":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    (key,) = common.unused(docs, "row")
    keep = each.withColumn("row", row(F.col("node"))).groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m")).select(F.col("m.row").alias(key))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wordless = ~text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.withColumn(key, row(F.md5(text.cast("binary"))))
    kept = rows.where(~wordless).join(keep, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(rows.where(wordless)).drop(key)
