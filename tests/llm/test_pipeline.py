"""The pipeline's stages against brute force over what the stage before kept."""

import re

import pytest

import corpus_pipeline
from fleetlens.llm import queries
from fleetlens.llm.common import landed
from tests.llm.test_operators import ODD, brute_components, brute_leaks
from tests.llm.test_passages import brute_passages


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    (_, one), (_, two), (_, three), (_, four), (_, five) = corpus_pipeline.STAGES
    a = landed(one(spark, docs, data), "a")
    assert a.columns == corpus_pipeline.COLUMNS and a.count() >= 0.97 * docs.count()
    b = landed(two(spark, a, data), "b")
    rows = [(r.doc_id, r.text) for r in a.collect()]
    assert sorted(r.doc_id for r in b.collect()) == sorted(d for d, _, c in brute_components(rows, 5, 80) if d == c)
    c = landed(three(spark, b, data), "c")
    before = sorted((r.doc_id, r.text) for r in b.collect())
    covers = {d: c for (d, _), c in zip(before, brute_passages([t.encode() for _, t in before], 51), strict=True)}
    left = {d: bytes(x for x, gone in zip(t.encode(), covers[d], strict=True) if not gone).decode() for d, t in before}
    assert {r.doc_id: r.text for r in c.collect()} == {d: t for d, t in left.items() if t.strip(" ") or not covers[d].any()}
    d = landed(four(spark, c, data), "d")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = [(r.doc_id, re.sub(r"\s+", " ", r.text)) for r in c.collect()]
    assert {r.doc_id for r in d.collect()} == {i for i, _ in kept} - {i for i, _ in brute_leaks(kept, items)}
    e = five(spark, d, data)
    assert e.count() == d.count() and e.filter("n_tokens = 0").count() == 0
    assert corpus_pipeline.run(spark, data).count() == e.count()


def test_odd_documents(spark, data, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    good = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    rows = [(i, t, None, None, None) for i, t in ODD]
    odd = good.unionByName(spark.createDataFrame(rows, good.schema)).unionByName(good.limit(2)).selectExpr("*", "'clash' as label", "'clash' as k1", "1 as score", "'x' as spans", "'y' as __text")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = landed(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.filter("text is null or text = ''").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.count() == docs.count() > 20 and docs.groupBy("doc_id", "text").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("ids", [(5, None, None), (5, 7, 7), (None, 5, 5), (None, None, None), (9, 9, 9)])
def test_near_copies_go_by_row(spark, data, ids):
    """Null and repeated ids: the near copy goes, the unrelated text stays, and so does one of equal rows."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join([*words[:-1], "edit"]), " ".join(f"other{i}" for i in range(60))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)] + [(ids[2], texts[2], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()]
    assert len(kept) == 2 and (ids[2], texts[2]) in kept
    first = [(i, t) for i, t in zip(ids[:2], texts[:2], strict=True) if i is not None]
    assert min(first)[0] in [i for i, _ in kept] if first else True


def test_no_documents(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
