import pytest

import corpus_pipeline
from conftest import SF001
from llm_edges import PROSE, frame
from loanscope.llm import language, neardup
from loanscope.llm.common import staged
from loanscope.llm.queries import QUERIES


def test_stages_chain_and_act(spark):
    docs = spark.read.parquet(SF001 + "/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF001), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert last.select("doc_id").distinct().count() == counts[-1]
    assert docs.where("n_chars != length(text)").count() == 0


def test_stages_take_edge_rows_and_nothing(spark):
    rows = frame(spark)
    for docs in (rows, rows.limit(0)):
        now = staged(docs, "edge-docs")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = staged(stage(spark, now, SF001), f"edge-{name}")
            assert now.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, now, SF001).collect()


def test_one_of_each_class_stays(spark):
    docs = spark.createDataFrame([(3, PROSE), (2, PROSE + " Tail."), (9, "something else entirely")], "doc_id long, text string")
    left = neardup.deduplicated(docs, "doc_id", "text").collect()
    assert sorted(r.doc_id for r in left) == [2, 9]


def test_language_stage_drops_what_has_no_letters(spark):
    docs = spark.createDataFrame([(0, "the house and the garden", "en", None, 1), (1, "12 34 !!", "en", None, 1), (2, None, "en", None, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    train = spark.createDataFrame([(4 * i, "the house and the other garden", "en", None, 1) for i in range(9)], docs.schema)
    got = corpus_pipeline.language_id(spark, docs.unionByName(train), SF001).where("doc_id < 3 and n_chars = 1").collect()
    assert 0 in {r.doc_id for r in got} and not {1, 2} & {r.doc_id for r in got}
    assert language.UNKNOWN == "und"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    assert QUERIES[name](spark, SF001).count() > 0
