import corpus_pipeline
from tandem.llm import exact, quality, simhash, toxicity
from tandem.llm.common import read_table
from tests.llm.conftest import EDGES, LABELS


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    for table in ("documents", "labels"):
        read_table(spark, "/root/testdata/sf0.001", table).write.parquet(f"{folder}/{table}.parquet")
    docs, labels = (read_table(spark, folder, t) for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.scores(docs, labels).collect() if r.predicted == 1}
    left = docs.filter(docs.doc_id.isin(good))
    mild = {r.doc_id for r in toxicity.scores(left, labels).collect() if r.predicted == 0}
    left = left.filter(left.doc_id.isin(mild))
    last = {r.doc_id for r in exact.mark(left).collect() if r.kept}
    left = left.filter(left.doc_id.isin(last))
    apart = {r.doc_id for r in simhash.components(left).collect() if r.doc_id == r.component_id}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == apart and 0 < len(apart) < docs.count()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_every_stage_takes_edges_and_empty_tables(spark, tmp_path, edges, nothing):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() >= (len(EDGES) - 9 if docs is edges else 0) or name == "toxicity"


def test_operators_of_the_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
