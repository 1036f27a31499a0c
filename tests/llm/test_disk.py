"""What the stages of the pipeline hold on disk between and after their steps."""

import os
import time

from pyspark.sql import functions as F

from strandframe.llm import common, line_dedup, ngram_join

TEXTS = [(i, f"a line that all share\nline {i // 3} of {'some few words that make shingles ' * 3}{'x' * (i % 2)}") for i in range(60)]


def shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for top in tops for _, _, names in os.walk(top.getPath()) for x in names if x.startswith("shuffle_")}


def test_stored_leaves_no_shuffle_files(spark, tmp_path):
    before, was = shuffle_files(spark), spark.conf.get(common.FILE_CLEANUP, None)
    out = common.stored(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count(), f"file://{tmp_path}/t")
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 97 and spark.conf.get(common.FILE_CLEANUP, None) == was


def test_only_what_results_read_stays(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out = line_dedup.dedup_lines(docs, work=f"file://{tmp_path}/lines")
    assert os.listdir(tmp_path / "lines") == ["gone"]
    assert out.count() == 60 and sorted(out.collect()) == sorted(out.collect())
    out = ngram_join.jaccard_components(docs, 3, 80, work=f"file://{tmp_path}/links")
    assert sorted(os.listdir(tmp_path / "links")) == ["known", "roots"]
    assert out.count() == 60 and out.select("component_id").distinct().count() < 60 and sorted(out.collect()) == sorted(out.collect())


def test_block_values_are_shuffled_one_at_a_time(spark, tmp_path, monkeypatch):
    """The blocks that sets share are a table before their members are looked up."""
    steps, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, path: steps.append(path.rsplit("/", 1)[-1]) or stored(df, path))
    ngram_join.jaccard_components(spark.createDataFrame(TEXTS, "doc_id long, text string"), 3, 80, work=f"file://{tmp_path}/links")
    assert steps[:3] == ["known", "blocks", "members"]
