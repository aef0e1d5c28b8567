"""The pipeline, stage by stage, on the small tables, against what each operator's own result says must stay."""

import collections

import corpus_pipeline as P
from lakemill.llm import decontam, minhash, mixing, queries, toxicity

from ..support import DATA, duck, same

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = P.toxicity_stage(spark, docs, SF).cache()
    assert kept.columns == columns and ids(kept) == sorted(r.doc_id for r in toxicity.judge(docs, labels).collect() if not r.predicted)
    once = P.near_dedup_stage(spark, kept, SF).cache()
    assert once.columns == columns and ids(once) == sorted({r.class_id for r in minhash.classes(kept).collect()})
    clean = P.decontamination_stage(spark, once, SF).cache()
    assert clean.columns == columns and ids(clean) == sorted(set(ids(once)) - {r.doc_id for r in decontam.leaks(once, benchmark).collect()})
    mixed = P.mixing_stage(spark, clean, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.plan(clean).collect() if r.copies}
    assert mixed.columns == columns and dict(collections.Counter(ids(mixed))) == copies
    out = P.token_stage(spark, mixed, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and ids(out) == ids(mixed)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and very long texts, clashing columns, and an empty table."""
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    rows = [(k, f"text {k} " + " ".join(f"v{k * 31 + j}" for j in range(30)), "en", "a", 9, "x", "y") for k in range(30)]
    rows += [rows[3], (30, None, None, None, None, None, None), (31, "", "en", "b", 0, "x", "y"), (32, long, "de", None, 5, "x", "y"), (33, long + " end", "de", "b", 5, "x", "y"), (None, "no id at all but some words here", "en", "b", 1, "x", "y"), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, size string"
    spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(30)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for made in (rows, []):
        docs = spark.createDataFrame(made, schema)
        for name, stage in P.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path)).cache()
            assert after.columns == docs.columns
            if name == "near_dedup" and made:
                got = collections.Counter(r.doc_id for r in after.collect())
                assert got[3] <= 1 and got[32] + got[33] == 1 and got[30] == got[31] == 1
            if name == "decontamination" and made:
                assert 7 not in {r.doc_id for r in after.collect()} and after.count() >= docs.count() - 1
            docs = after
        out = P.token_stage(spark, docs, str(tmp_path)).collect()
        assert len(out) == docs.count() and all(r.n_tokens >= 1 for r in out)


def test_run_leaves_only_its_result(spark):
    from lakemill.llm import common

    there = common.written()
    out = P.run(spark, SF)
    assert common.written() == there + 1 and out.count() > 0


def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    con = duck(SF)
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, SF), con, sql)
