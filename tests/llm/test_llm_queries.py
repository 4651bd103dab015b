"""The registered training-data queries over the smallest tables, and the pipeline's stages."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from pulsegrid.llm import registry
from pulsegrid.llm.common import table, written

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    # as Python values, in which a whole number stays one beside nulls
    plain = lambda rows: sorted(str([row[c] for c in sorted(columns)]) for row in rows)
    assert plain(r.asDict() for r in got.collect()) == plain(dict(zip(columns, r, strict=True)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"pipeline"}))
def test_query_has_a_row_for_each_document(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "documents").count()


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, sf_dir))
        assert out.columns == columns if k < len(corpus_pipeline.STAGES) - 1 else out.columns == [*columns, "shard", "slot"]
        assert 0 < out.count() <= (n if name != "mixing" else 3 * n)
        docs = out


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    """Null and empty texts, repeated rows, a null source and an empty table pass every stage."""
    docs = table(spark, sf_dir, "documents")
    some = docs.limit(40)
    odd = some.unionByName(some).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0)], docs.schema))
    for rows in (odd, docs.limit(0)):
        now = written(rows)
        for _, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, sf_dir))
        assert (now.count() > 0) == (rows is odd) and now.where("text is null or text = ''").count() == 0


def test_pipeline_leaves_its_result_alone(spark, sf_dir):
    """What the stages write for themselves is deleted, but nothing that another query has written."""
    from pulsegrid.llm.common import tables_noted

    other = written(spark.range(3))
    with tables_noted() as made:
        out = corpus_pipeline.run(spark, sf_dir)
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    left = [p for p in made if exists(p)]
    assert len(made) > 5 and len(left) == 1 and left[0].rsplit("/", 1)[-1] in out.inputFiles()[0]
    assert out.count() > 0 and other.count() == 3
