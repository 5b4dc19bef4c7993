"""The corpus pipeline, stage by stage, against plain rules on its own input."""

import shutil

import pytest

import corpus_pipeline
from test_operators import SF, brute_classes, odd_docs, shingles, toks
from tidemark.llm.common import table


@pytest.fixture()
def folder(tmp_path):
    for t in ("labels", "benchmark", "documents"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_stages(spark, folder, tmp_path):
    item, item2, item3 = (r.text for r in table(spark, folder, "benchmark").take(3))
    extra = [(900, "spotless prose " + item + " goes on", "a"), (901, "x password=b7db7aa4a5fcc78305 y", "a"),
             (None, "without an id " + item2 + " goes on", "a"), (903, "a b c d e f g h", "a"), (None, "a b c d e f g h", "a"),
             (903, "held twice " + item3 + " with another text", "a")]
    docs = odd_docs(spark, extra).unionByName(table(spark, folder, "documents").where("doc_id between 100 and 160"), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "mix":
            assert docs.columns == before.columns, name
        seen[name] = (before.collect(), docs.collect())
    rows, kept = seen["near_duplicates"]
    # rows numbered in place of their ids: one of each class stays, the first by id, nulls last
    order = sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is None, rows[k].doc_id or 0))
    stays = [rows[order[k]] for k, (n, _, c) in enumerate(brute_classes(
        [(k, rows[at].text) for k, at in enumerate(order)])) if n == c]
    key = lambda r: (str(r.doc_id), r.text or "")
    assert sorted(map(key, kept)) == sorted(map(key, stays)) and len(kept) < len(rows)
    rows, kept = seen["decontamination"]
    items = [shingles(r.text) for r in table(spark, folder, "benchmark").collect()]
    bad = [r for r in rows if any(len(q & shingles(r.text)) >= 0.75 * len(q) for q in items)]
    assert {900, 903, None} <= {r.doc_id for r in bad}
    assert sorted(map(key, [*kept, *bad])) == sorted(map(key, rows))
    assert 903 in {r.doc_id for r in kept}
    rows, kept = seen["secrets"]
    assert len(rows) == len(kept)
    assert {r.doc_id: r.text for r in kept}[901] == "x password=[SECRET] y"
    rows, kept = seen["mix"]
    assert sorted(len(toks(r.text)) for r in rows) == sorted(r["size"] for r in kept)


def test_empty_documents(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
