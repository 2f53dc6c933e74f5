"""The pipeline's stages, each held on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ladderflow.llm import line_dedup, pii, toxicity
from ladderflow.llm.common import materialize
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), name))
    return docs


def test_stages(results):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "pii", "packing"]
    assert all(df.dtypes == results[0].dtypes for df in results[1:5])
    counts = [df.count() for df in results[:5]]
    assert counts == sorted(counts, reverse=True) and counts[4] > 0.6 * counts[0]


def test_toxicity_stage(spark, results):
    scored = toxicity.predictions(results[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = sorted(r.doc_id for r in scored.where("predicted = 0").collect())
    assert kept == sorted(r.doc_id for r in results[1].collect())
    assert results[1].exceptAll(results[0]).count() == 0


def test_line_dedup_stage(results):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in results[1:3])
    gone = {r.doc_id: set(r.gone) for r in line_dedup.deletions(results[1]).collect()}
    for i, text in before.items():
        left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone.get(i, ()))
        assert after.get(i, "") == left if left.strip() or i not in gone else i not in after


def test_jaccard_stage(results):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in results[2:4])
    assert sorted(i for i, _ in after) == sorted({c for _, c in brute(before).values()})


def test_pii_stage(results):
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in results[4].collect() if "<" in r.text)
    assert sorted(r.doc_id for r in results[4].collect()) == sorted(r.doc_id for r in results[3].collect())


def test_packing_stage(results):
    filled: dict = {}
    for r in results[5].collect():
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in filled.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 1024
    total = results[5].agg(F.sum("length")).first()[0]
    assert len(filled) <= 1.03 * total / 1024 + 1


def test_run(spark, results):
    rows = cp.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in results[5].collect())


def test_empty_documents_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    odd = docs.limit(3).unionByName(docs.limit(1)).withColumns({"text": F.when(F.col("doc_id") % 2 == 0, F.col("text")), "_key": F.lit("k"), "_scored": F.lit("s"), "row": F.lit("r")})
    odd = materialize(odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), "odd")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.exceptAll(odd).where("row <> 'r' or _key <> 'k' or _scored <> 's'").count() == 0, name
        odd = materialize(out, f"odd-{name}")
    assert cp.STAGES[-1][1](spark, odd, SF).count() >= odd.count()
