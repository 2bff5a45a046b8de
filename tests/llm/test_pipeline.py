"""The pipeline's stages, each against a plain statement of what it must do; and the registered queries."""

import os

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from valueflow.llm import decontaminate, jaccard_join, quality, queries
from valueflow.llm.common import table, written
from valueflow.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in C.STAGES:
        after = written(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages, spark):
    assert [s[0] for s in stages] == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    columns = table(spark, SF, "documents").columns
    assert all(after.columns == columns for _, _, after in stages[:-1])
    assert stages[-1][2].columns == [*columns, "shard", "slot"]


def test_quality_keeps_what_it_predicts(stages, spark):
    _, before, after = stages[0]
    kept = quality.classify(before, table(spark, SF, "labels")).filter("_quality.predicted = 1")
    assert after.count() == kept.count() and after.exceptAll(kept.select(*after.columns)).count() == 0


def test_one_of_each_near_copy(stages):
    _, before, after = stages[1]
    assert jaccard_join.join(after).filter("_near.n_links > 0").count() == 0 or after.count() == before.select("doc_id").distinct().count()
    classes = jaccard_join.join(before).select("_near.class_id").distinct().count()
    assert after.count() == classes


def test_nothing_contaminated_left(stages, spark):
    _, before, after = stages[2]
    bench = table(spark, SF, "benchmark")
    assert decontaminate.find_windows(after, bench).filter(decontaminate.is_contaminated(F.col("_bench"))).count() == 0
    dirty = decontaminate.find_windows(before, bench).filter(decontaminate.is_contaminated(F.col("_bench"))).count()
    assert after.count() == before.count() - dirty


def test_mixing_copies_only_what_was_there(stages):
    _, before, after = stages[3]
    times = after.groupBy("doc_id").count()
    assert times.agg(F.max("count")).first()[0] <= 3
    assert times.join(before, "doc_id", "left_anti").count() == 0


def test_shards(stages):
    _, before, after = stages[4]
    assert after.count() == before.count()
    sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
    assert len(sizes) == C.SHARDS and max(sizes) - min(sizes) <= 1


def test_run(spark):
    assert C.run(spark, SF).columns[-2:] == ["shard", "slot"]


def test_run_keeps_the_last_table_only(spark):
    """Of the tables between the stages, only what the result reads is left."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {t for t in os.listdir(folder) if t.rpartition("-")[0] in dict(C.STAGES)}
    before = tables()
    out = C.run(spark, SF)
    assert [t.rpartition("-")[0] for t in tables() - before] == ["mixing"]
    assert out.count() > 0


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_every_operator_has_one_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
