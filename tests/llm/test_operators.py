"""Operators on small fixtures: brute force, round trips, and the defined results of odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakemill.llm import common, decontam, graph, html, langid, media, minhash, mixing, repeats, tokens, toxicity, urls
from lakemill.llm.queries import RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, start string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Clean rows, exact and near copies, nulls, empty and long texts, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(30, 120), 5000) for _ in range(40)]
    near = base[0].split()
    near[10] = "changed"
    texts = [*base, base[1], base[1], " ".join(near), None, "", "  \n", "one two", words(rng, 20_000), base[2] + " " + base[3], base[4][:200], "é" * 60 + base[4][:90]]
    out = [(k, t, ["en", "de", None][k % 3], ["a", "b", None, "c"][k % 4], len(t or ""), "x", "y", "z") for k, t in enumerate(texts)]
    return [*out, out[3], (None, "null id " + base[5], "en", "a", 1, "x", "y", "z"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def near_classes(rows):
    """Class of each row by all pairs: least doc_id of the component, alone for rows without words."""
    bags = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r[0]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(r[0], least[find(i)]) for i, r in enumerate(rows)]


WORKING = "row key tag whole_text k t whole cover id of copies same words own each bad class bucket n a b base rule links score _n _row _bad _text _key _tag".split()


@pytest.fixture(scope="module")
def clashing(docs):
    """docs with a column for every name that an operator uses while it works."""
    return docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in WORKING]).cache()


def test_extra_columns_pass_through(spark, clashing, docs):
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(40)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, docs.where("doc_id = 5").first()["text"])], "item_id long, text string")
    for run in (minhash.dedup, mixing.mix, repeats.remove, lambda d: decontam.clean(d, bench), lambda d: toxicity.reject(d, labels)):
        got, plain = run(clashing), run(docs)
        assert got.columns == clashing.columns and got.count() == plain.count()
        assert got.where(" OR ".join(f"`{c}` <> concat('{c} of ', coalesce(cast(doc_id AS string), 'none'))" for c in WORKING)).count() == 0
        assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))


# ------------------------------------------------------------------ 1 mixing


def test_mixing_meets_targets(docs, rows, empty):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    taken, largest = collections.defaultdict(int), collections.defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(docs.repartition(2)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan(empty).collect() == [] and mixing.mix(empty).collect() == []


# ------------------------------------------------------------------ 2 near-dedup


@pytest.mark.parametrize("fan", [256, 1])
def test_near_classes(docs, rows, empty, monkeypatch, fan):
    monkeypatch.setattr(minhash, "FAN", fan)
    got = [(r.doc_id, r.class_id) for r in minhash.classes(docs).collect()]
    assert sorted(got, key=repr) == sorted(near_classes(rows), key=repr)
    assert minhash.classes(empty).collect() == []


@pytest.mark.parametrize("fan", [256, 3])
def test_prefix_pairs_of_common_shingles(spark, monkeypatch, fan):
    """Stretches of one text: every shingle is a hot one, and sizes lie on and beside the bands' edges."""
    monkeypatch.setattr(minhash, "FAN", fan)
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[i : i + n]) for i, n in sorted({(int(i), int(n)) for i, n in zip(rng.integers(0, 8, 150), rng.integers(5, 50, 150), strict=True)})]
    texts += [" ".join(["a"] * n) for n in (8, 9, 10, 12, 13, 15, 19, 20, 24, 25)]
    nodes = spark.createDataFrame([(f"n{k}", f"c{k}", t) for k, t in enumerate(texts)], "node string, class string, text string")
    found = minhash._by_prefix(nodes, minhash.WORDS, minhash.THRESHOLD)
    got = {(r.a, r.b) for r in found.collect()}
    bags = {f"n{k}": collections.Counter(shingles(t)) for k, t in enumerate(texts)}
    near = {(a, b) for a in bags for b in bags if a < b and (bags[a] & bags[b]).total() >= minhash.THRESHOLD * (bags[a] | bags[b]).total()}
    assert len(near) > 20 and near <= got
    assert found.count() == len(got)


def test_near_dedup_keeps_one_of_each_class(docs, rows):
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    by_class = collections.Counter(c for (_, c), r in zip(near_classes(rows), rows, strict=True) if shingles(r[1]) and c is not None)
    wordless = sum(not shingles(r[1]) for r in rows)
    assert kept.count() == len(by_class) + wordless


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    grams = common.mix(np.arange(1, 401, dtype=np.uint64))
    x, y = rng.integers(1, 9, 400).astype(float), rng.integers(0, 9, 400).astype(float)
    signed = [minhash.signatures(g, w, np.zeros(len(g), np.int64), 1, 4096)[0] for g, w in ((grams, x), (grams[y > 0], y[y > 0]))]
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert (signed[0] == signed[1]).mean() == pytest.approx(want, abs=5 * (want * (1 - want) / 4096) ** 0.5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ------------------------------------------------------------------ 3 repeats


def cut_by_force(rows):
    seen = {}
    place = lambda d: float("inf") if d is None else d
    for r in rows:
        raw = (r[1] or "").encode()
        for i in range(len(raw) - 49):
            k = raw[i : i + 50]
            seen[k] = min(seen.get(k, float("inf")), place(r[0]))
    out = []
    for r in rows:
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < place(r[0]):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_by_force(spark, docs, rows, empty):
    got = [tuple(r) for r in repeats.digest(docs).collect()]
    assert sorted(got, key=repr) == sorted(cut_by_force(rows), key=repr)
    assert repeats.digest(empty).collect() == []
    rng = random.Random(9)
    tiny = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 160))) + "q" * rng.randrange(0, 120)) for k in range(60)]
    got = [tuple(r) for r in repeats.digest(spark.createDataFrame(tiny, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(cut_by_force(tiny))


def test_repeats_by_pieces_and_in_two_steps(spark, docs, rows, monkeypatch):
    want = sorted(cut_by_force(rows), key=repr)
    for name, value in (("PIECE", 50), ("FLUSH", 400), ("FANOUT", 2), ("PART_BYTES", 20_000), ("INDEX_SYMBOLS", 300)):
        monkeypatch.setattr(repeats, name, value)
    assert sorted((tuple(r) for r in repeats.digest(docs).collect()), key=repr) == want


def test_repeats_by_many_indexes_in_a_range(docs, rows, monkeypatch):
    made = []
    monkeypatch.setattr(repeats, "_contexts", lambda ranges, f=repeats._contexts: made.append(ranges) or f(ranges))
    for name, value in (("RANGES", 2), ("INDEXES", 1000), ("INDEX_SYMBOLS", 300)):
        monkeypatch.setattr(repeats, name, value)
    assert sorted((tuple(r) for r in repeats.digest(docs).collect()), key=repr) == sorted(cut_by_force(rows), key=repr)
    assert made == [2]


def test_anchors_of_a_long_text_by_windows(monkeypatch):
    text = np.frombuffer(words(random.Random(3), 4000, 300).encode(), np.uint8)
    offs = np.array([0, len(text)])
    (whole,) = repeats._anchored(text, offs)
    monkeypatch.setattr(repeats, "SCAN_BYTES", 700)
    parts = list(repeats._anchored(text, offs))
    assert len(parts) > 10
    got = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(got[1])
    assert all(np.array_equal(a[order], b) for a, b in zip(got, whole, strict=True))


def test_contexts_that_agree_on_no_side_need_no_index():
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, long = letters(34), letters(56)  # prose repeats 34 bytes by chance; only the longer passage holds a stretch
    texts = [letters(60) + (short if k < 40 else long) + letters(60) for k in range(44)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(44)), "tag": list(range(100, 144)), "text": texts})
    blobs = [next(repeats._each(b.slice(i, 1))) for b in repeats._scan(2)([batch]) for i in range(b.num_rows)]
    again = {}
    for part in {b[0] for b in blobs}:
        own = list(repeats._blobs([b for b in blobs if b[0] == part]))
        for batch in repeats._gather(True)(repeats._resolve(1)(own)):
            again |= {k: len(f) // 4 for k, f in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True) if f}
    assert set(again) == {40, 41, 42, 43}
    assert [r[0] for r in cut_by_force(list(enumerate(texts))) if r[2]] == [41, 42, 43]


@pytest.mark.parametrize("depth,letters", [(3, 2), (5, 4), (26, 300)])
def test_run_length_index(depth, letters):
    rng = np.random.default_rng(depth)
    strings = [rng.integers(0, letters, rng.integers(1, 52)) for _ in range(200)] + [np.arange(40) % letters] * 4
    owner = rng.integers(0, 30, len(strings))
    index = repeats.RunLengthIndex(np.concatenate(strings), np.array([len(s) for s in strings]), owner, depth)
    got = set(zip(*(x.tolist() for x in index.stream(owner)), strict=True))
    least = {}
    for s, o in zip(strings, owner, strict=True):
        for i in range(len(s) - depth + 1):
            least[tuple(s[i : i + depth])] = min(least.get(tuple(s[i : i + depth]), 99), o)
    assert got == {(n, i) for n, s in enumerate(strings) for i in range(len(s) - depth + 1) if least[tuple(s[i : i + depth])] < owner[n]}


def test_remove_cuts_texts(docs, rows):
    out = repeats.remove(docs).collect()
    kept = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out}
    whole = {(r[0], r[4]) for r in cut_by_force(rows)}
    # a character that is cut in part goes whole, so only texts beyond ASCII may differ
    assert len(out) == len(rows) and {d for d, _ in whole - kept} <= {r[0] for r in rows if not (r[1] or "").isascii()}
    assert sum(r.text is None for r in out) == sum(r[1] is None for r in rows)


# ------------------------------------------------------------------ 4 tokens


def test_token_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    got = tokens.round_trip(docs, tokenizer_path()).collect()
    ids = sorted(((r[0], coder.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is not None, d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in ordered] == sorted((d is not None, d or 0) for d, _ in ids)
    assert tokens.round_trip(empty, tokenizer_path()).collect() == []
    path = common.new_dir(spark, "tokens")
    tokens.write(docs, path, tokenizer_path())
    plain, shuffled = tokens.read(spark, path).collect(), tokens.read(spark, path, seed=3).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, shuffled))


@pytest.mark.parametrize("text", ["Don't stop...  it's 3.14, ok.Then A.B. é. İstanbul ΣΑΣ.", "<|endoftext|> a <|STARTOFTEXT|> <|x", "a. b, c.. d., ,. . ́x é́. 'S 中文。 🙂. ﬁ. ½,", "x y z", "", " \n"])
def test_encoder_agrees_with_the_library(text):
    coder = tokens.Encoder(tokenizer_path())
    raw = np.frombuffer(text.encode(), np.uint8)
    assert coder.encode(raw, np.array([0, len(raw)]), 2)[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_damaged_frames_are_refused():
    good = tokens.frame(np.array([1, 2, 70_000]))
    assert tokens.unframe(memoryview(good)).tolist() == [1, 2, 70_000]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            tokens.unframe(memoryview(bytes(bad)))


# ------------------------------------------------------------------ 5 urls


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "https://a.example.org/en/1x", ""),  # blocked by rule
        (2, "http://x.net/p", '<link rel="canonical" href="https://a.example.org/en/1x">'),  # alias of a blocked page
        (3, "http://x.net/p?utm_source=f#top", None),  # same normal form
        (4, "http://y.net/q", "<meta http-equiv='refresh' content='0; url=http://x.net/p'>"),
        (5, "http://z.com/de/1", '<link rel=canonical href="http://z.org/ok">'),
        (6, "http://w.net/1", '<link rel=canonical href="http://z.com/de/1">'),  # its class holds an allowed page
        (7, None, None), (8, "nonsense", None), (None, "HTTP://EXAMPLE.ORG/es/", None), (9, "ftp://Org?x", None), (9, "ftp://Org?x", None),
    ]
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int"), RULES).collect()}
    assert got[1, "a.example.org", "/en/1x"] == ("example.org/en/1", "block")
    assert got[2, "x.net", "/p"] == got[3, "x.net", "/p"] == got[4, "y.net", "/q"] == (None, "block")
    assert got[5, "z.com", "/de/1"] == ("com/de/", "block") and got[6, "w.net", "/1"] == (None, "allow")
    assert got[7, "", ""] == got[8, "", ""] == got[9, "org", ""] == (None, "allow")
    assert got[None, "example.org", "/es/"] == ("example.org/es/", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []


def test_many_rules_and_links_by_force(spark):
    rng = random.Random(12)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + rng.choice([".com", ".org"]) for _ in range(40)]
    place = lambda: "/" + "/".join(rng.choice("xyz") for _ in range(rng.randrange(0, 4)))
    rules = list({(".".join(rng.choice(hosts).split(".")[rng.randrange(0, 3) :]), place()): rng.choice(["allow", "block"]) for _ in range(30)}.items())
    rules = [(h, p, v) for (h, p), v in rules if h.count(".")] + [(f"z{k}.net", place(), "block") for k in range(3000)]
    pages = []
    for k in range(300):
        link = rng.choice(["", "", f"http://{rng.choice(hosts)}{place()}", place(), "x/../y?b=1&amp;a=2", "../z", "?q=1", "#top", "mailto:a@b.c"])
        pages.append((k, f"https://{rng.choice(hosts)}{place()}", rng.choice(['<LINK REL="canonical" HREF="{}">', "<meta http-equiv=refresh content='3; URL={}'><link rel=x href=/no>", '<p>x</p><meta property="og:url" content="{}">']).format(link) if link else "<p>"))

    def parts(url):
        host, path, query = re.match(r".*?://([^/?#]*)([^?#]*)\??([^#]*)", url).groups()
        return host, path, query

    def rule(url):
        host, path, _ = parts(url)
        fits = [(len(h), len(p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3:] if fits else (None, None)

    def node(url):
        host, path, query = parts(url)
        kept = sorted(q for q in query.split("&") if q)
        return host + re.sub(r"/+$", "", path) + ("?" + "&".join(kept) if kept else "")

    import urllib.parse

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    known = collections.defaultdict(set)
    for _, url, html_ in pages:
        known[node(url)].add(rule(url)[1])
        for link in re.findall(r'(?i)(?:canonical" href="|url=|url" content=")([^"\'>]+)', html_):
            target = urllib.parse.urljoin(url, link.replace("&amp;", "&")).split("#")[0]
            if link[0] != "#" and target.startswith("http"):
                parent[find(node(target))] = find(node(url))
                known[node(target)].add(rule(target)[1])
    spread = collections.defaultdict(set)
    for n, verdicts in known.items():
        spread[find(n)] |= verdicts - {None}
    want = {k: (rule(u)[0], rule(u)[1] or (min(spread[find(node(u))]) if spread[find(node(u))] else "allow")) for k, u, _ in pages}
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got == want
    alone = {k: rule(u)[1] or "allow" for k, u, _ in pages}
    assert any(alone[k] != v for k, (_, v) in got.items())  # the links decide some


# ------------------------------------------------------------------ 6 toxicity


def test_toxicity_and_counterfactuals(spark, empty):
    rng = random.Random(2)
    made, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        text = words(rng, 40) + (" you stupid moron." if bad else " fine.")
        if bad and k % 8 == 0:
            text += " muslim men did."  # identity terms lean toward the toxic class
        made.append((k, text))
        labels.append((k, int(bad)))
    labels += [(None, 1), (5, None), (10_000, 1)]
    docs = spark.createDataFrame([*made, (700, None), (701, ""), (None, "stupid moron"), (702, words(rng, 30) + " muslim men met.")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, marks).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[k].predicted == v for k, v in labels[:600])
    assert got[702].predicted == got[700].predicted == got[701].predicted == 0 and got[None].predicted == 1
    assert {k for k in range(600) if got[k].held_out} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    strict, loose = (toxicity.fit(docs, marks, penalty=p) for p in (100.0, 0.0))
    weight = lambda m, w: float(m.weights[np.searchsorted(m.words, np.uint64(toxicity.word_hash(w)))])
    assert abs(weight(strict, "men") - weight(strict, "women")) < 0.2 * abs(weight(loose, "men") - weight(loose, "women"))
    assert toxicity.reject(docs, marks).count() == 604 - sum(r.predicted for r in got.values())
    assert toxicity.judge(empty, marks).collect() == []
    assert {r.predicted for r in toxicity.judge(docs, marks.limit(0)).collect()} == {0}


def test_scores_by_force(spark):
    rng = random.Random(21)
    stems = [np.uint64(rng.getrandbits(64)) for _ in range(3)]
    texts = [" ".join(rng.choice(["idiot", "Idiots", "idiotic", "moronic", "moron", "ÉTÉ", "fine", "a", "x1y"]) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + ["", None, "idiot " * 5000]

    def stem(prefix, times):
        raw = np.frombuffer(prefix.encode(), np.uint8)
        with np.errstate(over="ignore"):
            return (common.hash_spans(raw, np.array([0]), np.array([len(raw)])) * np.uint64(2 * len(raw) + 1) ^ toxicity._TIMES[times - 1])[0]

    features = {("word", "idiot"): 1.5, ("word", "été"): -2.0, ("word", "y"): 0.25, ("idio", 2): 0.75, ("moron", 1): 1.0, ("idiot", 3): -0.5}
    hashes = np.array([np.uint64(toxicity.word_hash(k[1])) if k[0] == "word" else stem(*k) for k in features] + stems, np.uint64)
    model = toxicity.Model(hashes, np.array([*features.values(), 9.0, 9.0, 9.0]), -0.4)
    want = []
    for t in texts:
        seen = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        z = -0.4 + sum(w for k, w in features.items() if (k[1] in seen if k[0] == "word" else sum(x.startswith(k[0]) for x in seen) >= k[1]))
        want.append(1 / (1 + np.exp(-z)))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(5)
    long = words(rng, 30_000, 900)
    made = [(k, words(rng, 20) + (" vile moron" if k % 3 == 0 else ""), "x", k) for k in range(120)] * 2 + [(900, long, "x", 1), (901, long + " vile moron", "x", 1), (902, "vile moron", "x", 1), (902, "vile moron", "x", 2)]
    docs = spark.createDataFrame(made, "doc_id long, text string, toxic string, score int")
    marks = spark.createDataFrame([(k, int(k % 3 == 0), 2) for k in range(120)], "doc_id long, toxic int, text int")
    got = toxicity.judge(docs, marks).collect()
    assert len(got) == len(made)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.score, r.predicted))
    assert all(len(x) == 1 for x in by.values())  # repeated rows score alike
    assert {k: min(by[k])[1] for k in (900, 901, 902)} == {900: 0, 901: 1, 902: 1}
    assert sorted(toxicity.judge(docs.repartition(5), marks).collect()) == sorted(got)


# ------------------------------------------------------------------ 7 decontamination


def test_leaks(spark, empty):
    rng = random.Random(4)
    items = [words(rng, 30, 3000) for _ in range(8)] + ["tiny item", None, ""]
    edited = items[1].split()
    for k in (5, 13, 22):
        edited[k] = "edit"
    half = " ".join(items[2].split()[:16])
    docs = [(0, words(rng, 50, 3000) + " " + items[0].upper() + ", " + words(rng, 50, 3000)), (1, "x " + " ".join(edited)), (2, half + " " + words(rng, 900, 3000)), (3, words(rng, 300, 3000)), (4, None), (5, ""), (6, "a tiny item here"), (7, items[3] + " " + items[3] + " " + items[4]), (None, items[5]), (3, items[6][:20]), (8, "Tiny item.")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (8, 8), (7, 3), (7, 4), (None, 5)}
    assert sorted((r.doc_id for r in decontam.clean(frame, bench).collect()), key=repr) == sorted([3, 4, 5, 3, 6], key=repr)
    assert decontam.leaks(empty, bench).collect() == [] and decontam.leaks(frame, bench.limit(0)).collect() == []


def test_leaks_of_edited_copies_match_alignment_of_every_pair(spark):
    rng = random.Random(8)
    items = [words(rng, rng.choice([5, 9, 15, 30, 60]), 3000) for _ in range(20)]
    docs = []
    for item in items:
        for every in (4, 5, 6, 7):
            edited = [f"new{k}" if k % every == every - 1 else w for k, w in enumerate(item.split())]
            docs.append(words(rng, 40, 3000) + " " + " ".join(edited) + " " + words(rng, 40, 3000))
        for share in (0.1, 0.25, 0.4):
            edited = [rng.choice(["", "new", w + " more"]) if rng.random() < share else w for w in item.split()]
            docs.append(words(rng, 40, 3000) + " " + " ".join(edited))
        docs.append(item + " " + words(rng, 40, 3000))  # an intact copy must not hide the edited ones
    bench, frame = list(enumerate(items)), list(enumerate(docs))
    table = decontam.Items(bench)
    want = {}
    for d, text in frame:
        raw = text.encode()
        folded, _ = decontam.folded_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for k, _ in bench:
            item = table.of(k)
            score, matches, _, _ = decontam.align(item, folded)
            if score >= 0.4 * len(item) and matches >= min(8, len(item)):
                want[d, k] = score / len(item)
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(spark.createDataFrame(frame, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(want) > 100 and got == want


def test_short_items_inside_longer_texts(spark):
    docs = spark.createDataFrame([(1, "we saw a red Fox today"), (2, "red."), (3, "no match here"), (4, None), (5, "red fox")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "a red fox")], "item_id long, text string")
    pairs = lambda **how: {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, share=1.0, **how).collect()}
    assert pairs() == {(2, 2), (5, 1)}
    assert pairs(shortest=1) == {(1, 1), (1, 2), (1, 3), (2, 2), (5, 1), (5, 2)}


def test_a_text_full_of_seeds(spark):
    rng = random.Random(1)
    item = words(rng, 60, 40)
    docs = spark.createDataFrame([(1, words(rng, 30_000, 40)), (2, item), (2, item)], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), share=0.9).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in got] == [(2, 7, 1.0)] * 2


def test_alignment_matches_plain_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()


# ------------------------------------------------------------------ 8 language ID


def test_language_id(spark, empty):
    rng = random.Random(8)
    kinds = {"en": "the of and thing with", "de": "der und nicht über schön", "fr": "le et une être çà", "es": "el y una según niño"}
    rows = [(k, " ".join(rng.choice(kinds[c].split()) + rng.choice(["", "er", "ion"]) for _ in range(20)), c) for k, c in enumerate(list(kinds) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (902, "", None), (None, "und nicht über", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert np.mean([got[k].lang_pred == c for k, _, c in rows if got[k].held_out]) > 0.95
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.identify(empty).collect() == []


def test_many_languages_in_groups(spark):
    rng = random.Random(4)
    codes = [f"q{chr(97 + k)}" for k in range(20)]
    stock = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(8)] for c in codes}
    rows = [(k, " ".join(rng.choice(stock[c]) for _ in range(15)), c, "x", 1) for k, c in enumerate(codes * 12)] + [(5000, " ".join(stock["qc"] * 9000), "qc", "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string, turn int")
    got = langid.identify(docs).collect()
    lang = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95
    assert len({tuple(r) for r in got if r.doc_id == 5000}) == 1


def test_votes_by_force():
    rng = np.random.default_rng(2)
    langs = np.array(["de", "en", "fr", "nl", "it", "xx"] * 30, object)
    x = rng.random((len(langs), langid.DIMENSIONS)).astype(np.float32)
    for k, c in enumerate(sorted(set(langs))):
        x[langs == c, k * 10 : k * 10 + 10] += 3
    model = langid.Model(sorted(set(langs)), x, langs)
    margins = x.astype(float) @ model.weights + model.offset
    chosen, score = model.choose(margins)
    for row in range(0, len(langs), 7):
        f = max(range(len(model.families)), key=lambda k: margins[row, k])
        votes = collections.Counter({m: 0 for m in model.members[f]})
        for a, b, k in model.pairs[f]:
            votes[a if margins[row, k] >= 0 else b] += 1
        assert votes[chosen[row]] == max(votes.values()) and 0 <= score[row] <= 1
    assert np.mean([model.langs[k] == c for k, c in zip(chosen, langs, strict=True)]) > 0.99


# ------------------------------------------------------------------ 9 HTML


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><div id=sidebar><p>links</div><form><label>Name<input></label></form>
<article><h1>A &amp; B&nbsp;C</h1><p>one<br>two <b>th</b>ree<p>4 &lt; 5 <script>var x="</p>";</script><aside>note</aside><ul><li>x<li>y</ul>
<div class="ad">buy</div></article><section class="comments"><p>first!</p></section><footer>&copy; 2020</footer></body></html>"""


def test_blocks_of_a_page():
    assert [t for z, t in html.blocks(PAGE) if z == "main"] == ["A & B C", "one two three", "4 < 5", "x", "y"]
    assert html.blocks("") == [] and html.blocks("plain &amp; text") == [("open", "plain & text")]
    assert [t for z, t in html.blocks("<article><p>cut of") if z == "main"] == ["cut of"]


def test_repeated_open_blocks_go(spark):
    line = "Sign up for our weekly letter and never miss a story again"
    pages = [(k, f"http://h.org/{k}", f"<div><p>{line} today</p><p>own text number {k} of this page alone {k * 7}</p></div>") for k in range(5)]
    pages += [(10, "http://h.org/10", PAGE), (11, "http://h.org/11", PAGE), (12, "http://h.org/12", PAGE), (13, None, None), (14, "http://o.org", f"<p>{line} today</p>"), (None, "http://o.org", "<nav>x</nav>")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(pages)
    assert all(got[k].text == f"own text number {k} of this page alone {k * 7}" for k in range(5))
    assert got[10].text == got[11].text == got[12].text == "A & B C\none two three\n4 < 5\nx\ny" and got[10].n_chars == len(got[10].text)
    assert got[13].text == "" and got[None].text == "" and got[14].text == line + " today"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("tokens", [html.HOST_TOKENS, 1])
def test_runs_count_every_page_of_a_block(spark, monkeypatch, tokens):
    monkeypatch.setattr(html, "HOST_TOKENS", tokens)
    notice = "we use cookies on this site to help all of you"
    pages = [(1, "https://a.org/1", f"<p>alpha {notice}</p><p>one</p>"), (2, "https://a.org/2", f"<p>alpha {notice}</p><p>two</p>"), (3, "https://a.org/3", f"<p>beta {notice}</p><p>three</p>")]
    # two blocks of the same least page that stand on different pages besides
    other = "read more of this in our weekly letter to readers"
    pages += [(4, "https://b.org/4", f"<p>alpha {other}</p><p>beta {other}</p><p>four</p>"), (5, "https://b.org/5", f"<p>alpha {other}</p><p>five</p>"), (6, "https://b.org/6", f"<p>beta {other}</p><p>six</p>")]
    # two pages are too few
    pages += [(k, f"https://c.org/{k}", f"<p>name{k} {notice}</p>") for k in (7, 8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: f"name7 {notice}", 8: f"name8 {notice}"}


def test_runs_of_a_hot_host_are_those_of_a_small_one(spark, monkeypatch):
    rng = random.Random(6)
    notice = "we use cookies on this site to help all of you"
    pages = [(k, f"https://{'a.org' if k % 5 else 'b.org'}/{k}", f"<p>{words(rng, 1, 3000)}{k} {notice}</p><p>{words(rng, rng.choice([2, 9, 30]), 3000)}</p><p>{words(rng, 6, 3)}</p>") for k in range(60)]
    pages += [(60 + k, None, f"<p>name{k} {notice}</p><p>own text {k}</p>") for k in range(4)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").cache()
    small = {(r.page_id, r.text) for r in html.extract(frame).collect()}
    monkeypatch.setattr(html, "HOST_TOKENS", 1)
    hot = {(r.page_id, r.text) for r in html.extract(frame).collect()}
    assert len(small) == 64 and not any(notice in t for _, t in small)
    assert hot == small


def test_words_of_class_names_and_inline_elements():
    page = """<article><p>Press <label>Start</label> and see <output>42</output> and <math><mi>x</mi></math>.</p><p class="legal history">Law then</p>
    <div class="related-work"><p>Others did</p></div><div class="ad-slot-2">buy</div><p class="notice">mind</p><div class="comment-list"><p>first!</p></div><form><label>Name</label></form></article>"""
    assert html.blocks(page) == [("main", "Press Start and see 42 and x."), ("doubt", "Law then"), ("doubt", "Others did"), ("chrome", "buy"), ("chrome", "mind"), ("chrome", "first!"), ("chrome", "Name")]


def test_extraction_by_force(spark):
    rng = random.Random(14)
    shared = [words(rng, rng.randrange(3, 12), 50) for _ in range(12)]
    pages = []
    for k in range(80):
        parts = [f"<p>{rng.choice(shared)} {words(rng, rng.choice([0, 1, 6]), 4000)}</p>" if rng.random() < 0.5 else f"<p>{words(rng, rng.randrange(1, 40), 4000)}</p>" for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.4:
            parts = ["<article><h1>t</h1>", *[p.replace("<p>", '<p class="legal history">') if rng.random() < 0.5 else p for p in parts], "</article>"]
        pages.append((k, f"http://{rng.choice('ab')}.org/{k}", "<nav>menu</nav>" + "".join(parts)))
    pages.append((80, "http://a.org/long", f"<article><p>{words(rng, 40_000, 5000)}</p></article>"))
    found, on, where = {}, collections.defaultdict(set), collections.defaultdict(set)
    grams = lambda t: [tuple(t[i : i + html.RUN]) for i in range(len(t) - html.RUN + 1)] if len(t) >= html.RUN else [tuple(t)]
    for k, url, page in pages:
        blocks = [b for b in html.blocks(page) if b[0] != "chrome"]
        if {z for z, _ in blocks} & {"main", "doubt"}:
            blocks = [b for b in blocks if b[0] != "open"]
        found[k] = blocks
        for z, t in blocks:
            if z != "main":
                where[url[7], t].add(k)
                for g in grams(t.split()):
                    on[url[7], g].add(k)

    def boilerplate(host, t):
        w, hit = t.split(), [False] * len(t.split())
        for i, g in enumerate(grams(w)):
            if len(on[host, g]) >= html.PAGES:
                hit[i : i + len(g)] = [True] * len(g)
        return len(where[host, t]) >= html.PAGES or sum(hit) / len(w) >= html.COVERED

    want = {k: "\n".join(t for z, t in found[k] if z == "main" or not boilerplate(url[7], t)) for k, url, _ in pages}
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want
    assert any(want[k] != "\n".join(t for _, t in found[k]) for k in want)  # the host's runs decide some


@pytest.mark.parametrize("host", ["a.org", None])
def test_template_inside_articles_goes(spark, host):
    rng = random.Random(21)
    notice, line, copied = "Get our weekly letter and never miss a story again", "a closing line that every third article shares", words(rng, 60, 5000)
    own = {k: [words(rng, 30, 5000), *([line] if k % 3 == 0 else []), words(rng, 20, 5000)] for k in range(40)}
    page = lambda blocks: f"<nav>x</nav><article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>"
    url = lambda k: host and f"http://{host}/{k}"
    # every page of the host carries the notice, at places and with words of its own
    pages = [(k, url(k), page([own[k][0], f"{notice} {k}", *own[k][1:]])) for k in own]
    # copies of one article, one of them with the notice, and a page that is the notice
    pages += [(100 + k, url(k), page([copied])) for k in range(9)] + [(200, url(200), page([copied, notice])), (201, url(201), page([notice])), (202, url(202), None)]
    # a host of few pages, and one whose pages are copies with small edits, has no template
    pages += [(300 + k, f"http://few.org/{k}", page([own[k][0], notice])) for k in range(9)]
    pages += [(400 + k, f"http://copies.org/{k}", page([copied, f"edited {k}"])) for k in range(30)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html.extract(frame).collect()}
    want = {k: "\n".join(own[k]) for k in own} | {100 + k: copied for k in range(9)} | {200: copied, 201: notice, 202: ""}
    want |= {300 + k: f"{own[k][0]}\n{notice}" for k in range(9)} | {400 + k: f"{copied}\nedited {k}" for k in range(30)}
    assert got == want


def test_template_keeps_half_of_a_page():
    runs = {"a b c d", "b c d e", "so"}
    assert html.without_template("a b c d e\nso\none two three four five six", runs) == "one two three four five six"
    assert html.without_template("a b c d e\none two", runs) == "a b c d e\none two"
    assert html.without_template("x a b c d y z\nso it is", runs) == "x a b c d y z\nso it is" and html.without_template("", runs) == ""


def test_suffix_array_coverage_by_force():
    rng = random.Random(6)
    texts = [words(rng, rng.randrange(1, 30), 6) for _ in range(40)]
    pages = [k // 3 for k in range(40)]
    on = collections.defaultdict(set)
    grams = lambda w: [tuple(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [tuple(w)]
    for t, p in zip(texts, pages, strict=True):
        for g in grams(t.split()):
            on[g].add(p)
    want = []
    for t in texts:
        w = t.split()
        hit = [False] * len(w)
        for i, g in enumerate(grams(w)):
            if len(on[g]) >= 3:
                hit[i : i + len(g)] = [True] * len(g)
        want.append(sum(hit) / len(w))
    assert html.covered_tokens(texts, pages) == pytest.approx(want)


# ------------------------------------------------------------------ 10 media


def png_rows(raw):
    """Rows of an 8-bit greyscale PNG, read by the standard and with all its filters."""
    import struct

    assert raw[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, body = 8, b""
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + data)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", data)
            assert (depth, colour, lace) == (8, 0, 0)
        body += data if kind == b"IDAT" else b""
        at += 12 + size
    body, out, last = zlib.decompress(body), [], [0] * width
    for y in range(height):
        kind, line = body[y * (width + 1)], list(body[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width if kind else 0):
            a, b, c = line[x - 1] if x else 0, last[x], last[x - 1] if x else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line[x] = (line[x] + [0, a, b, (a + b) // 2, near][kind]) % 256
        out.append(line)
        last = line
    return out


def test_media_round_trip(spark, docs, rows, empty):
    got = media.round_trip(docs).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        payload = media.pad((r[1] or "").encode())
        assert len(payload) % 576 == 0 and len(payload) > 0
        want.append((r[0], len((r[1] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert len({(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in got}) == len({r[1] or "" for r in rows})
    path = common.new_dir(spark, "media")
    media.write(docs, path)
    by = {r.payload_sha256: r for r in got}
    for r in media.read(spark, path).collect():
        rows_ = png_rows(bytes(r.media))
        flat = [x for row in rows_ for x in row]
        same = by[hashlib.sha256(bytes(flat)).hexdigest()]
        assert (same.media_bytes, same.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        counts = [sum(x // 32 == k for x in flat) for k in range(8)]
        assert same.feature == f"rows={len(rows_)};sum={sum(flat)};hist={','.join(map(str, counts))}"
    assert media.round_trip(empty).collect() == []


def test_media_retries_members_alone(spark, docs, monkeypatch):
    path = common.new_dir(spark, "media")
    media.write(docs, path, stride=1000)
    reader = media.ArchiveReader({"path": path, "retries": "2", "on_error": "null"})
    parts = reader.partitions()
    assert len(parts) > 3 and [p for name in dict.fromkeys(p.name for p in parts) for p in reader.ranges_of(name)] == parts

    class Flaky:
        def __init__(self, f):
            self.f, self.calls = f, 0

        def read_at(self, n, at):
            self.calls += 1
            if self.calls % 2:
                raise OSError("flaky")
            return self.f.read_at(n, at)

    with media.fs.FileSystem.from_uri(path)[0].open_input_file(f"{media.fs.FileSystem.from_uri(path)[1]}/{parts[0].name}") as f:
        own = np.frombuffer(f.read_at(media.ENTRY.itemsize, parts[0].directory), media.ENTRY)[0]
        assert reader.member(Flaky(f), own)[1] is None
        bad = own.copy()
        bad["crc"] ^= 1
        assert reader.member(f, bad) == (None, "checksum differs")
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == docs.count()
