import hashlib
import os
import subprocess
import sys
import uuid

import duckdb
import pytest

from tandem.llm.exact import DigestIndex, digest_rows, keep, mark
from tandem.llm.queries import ORACLES
from tests.llm.conftest import EDGES, documents


def test_marks_against_brute_force(edges):
    groups = {}
    for i, t in EDGES:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in EDGES:
        ids = [x for x in groups[t or ""] if x is not None]
        best = max(ids) if ids else None
        want.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, mark(edges).collect()))) == sorted(map(str, want))


def test_keep_leaves_one_row_a_text_with_its_columns(edges):
    rows = keep(edges).collect()
    assert rows[0].__fields__ == edges.columns and {r.digest for r in rows} == {"mine"}
    assert sorted(r.text or "" for r in rows) == sorted({t or "" for _, t in EDGES})
    assert {r.doc_id for r in rows if r.text == "The same words, twice."} == {6}


def test_a_hot_group_is_whole(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(900)]
    found = mark(documents(spark, rows)).collect()
    assert sum(r.kept for r in found) == 301
    assert {(r.keep_id, r.group_size) for r in found if r.doc_id % 3} == {(899, 600)}


def test_the_index_persists_and_meets_new_rows(spark):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets=2)
    index.add(digest_rows(documents(spark, [(1, "a"), (2, "b"), (5, "b")])))
    index.add(digest_rows(documents(spark, [(9, "b"), (7, "c")])))
    assert {r.keep_id for r in DigestIndex(spark, index.name).read().collect()} == {1, 5, 7}
    plan = spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()
    assert any(r.col_name == "Bucket Columns" and "digest" in r.data_type for r in plan)
    spark.sql(f"DROP TABLE {index.name}")


SESSION = """
import sys
from pyspark.sql import SparkSession
from tandem.llm.exact import DigestIndex, digest_rows
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
index = DigestIndex(spark, "known_digests", buckets=int(sys.argv[3]), path=sys.argv[1])
index.add(digest_rows(spark.createDataFrame(eval(sys.argv[4]), "doc_id long, text string")))
print("FOUND", index.buckets, sorted((r.keep_id for r in index.read().collect())))
"""


def test_the_index_outlives_its_session(tmp_path):
    root, found = os.path.dirname(os.path.dirname(os.path.dirname(__file__))), []
    for buckets, rows in ((3, [(1, "a"), (2, "b")]), (5, [(9, "b"), (7, "c")])):
        run = subprocess.run([sys.executable, "-c", SESSION, str(tmp_path / "index"), str(tmp_path / "house"),
                              str(buckets), repr(rows)], capture_output=True, text=True, cwd=tmp_path,
                             env={**os.environ, "PYTHONPATH": root}, timeout=300)
        found.append([line for line in run.stdout.splitlines() if line.startswith("FOUND")] or run.stderr[-2000:])
        if len(found) == 1:
            files = {f.name for f in (tmp_path / "index").glob("*.parquet")}
    assert found == [["FOUND 3 [1, 2]"], ["FOUND 3 [1, 2, 7]"]]
    assert files and files < {f.name for f in (tmp_path / "index").glob("*.parquet")}


def test_a_folder_of_something_else_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="no digest index"):
        DigestIndex(spark, f"digests_{uuid.uuid4().hex}", path=f"{tmp_path}/other")
    assert spark.read.parquet(f"{tmp_path}/other").count() == 3


def test_columns_of_any_name_come_back(spark):
    from tandem.llm import simhash

    rows = [(1, "same text of a few words", "x", 1, "p"), (2, "same text of a few words", "y", 2, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, `meta.x` int, order string")
    assert [tuple(r) for r in keep(docs).collect()] == [rows[1]]
    assert [tuple(r) for r in simhash.keep(docs).collect()] == [rows[0]]
    assert keep(docs).columns == simhash.keep(docs).columns == docs.columns


def test_no_table_is_left_behind(spark, edges):
    before = {t.name for t in spark.catalog.listTables()}
    mark(edges).count(), keep(edges).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_no_python_on_the_way(edges):
    plan = mark(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(nothing):
    assert mark(nothing).count() == 0 and keep(nothing).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_equals_sql(spark, sf):
    from tandem.llm.queries import QUERIES

    folder = f"/root/testdata/{sf}"
    frame = QUERIES["op9_exact_dedup"](spark, folder)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        result = db.execute(ORACLES["op9_exact_dedup"])
        names = [d[0] for d in result.description]
        want = sorted(result.fetchall())
    assert sorted(tuple(r) for r in frame.select(*names).collect()) == want
