from conftest import SF
from pyspark.sql import functions as F

from contestry.llm import lbl


def test_warm_up_takes_a_share_of_copies_and_keeps_partitions(spark):
    docs = spark.range(9600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text of many rows")).otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit(False).alias("held_out")).repartition(6)
    warm = lbl.warm_up(docs)
    copies = warm.where("text = 'one text of many rows'").count()
    assert 100 <= warm.count() <= 200 and 3200 / 128 <= copies <= 3200 / 32
    assert warm.rdd.getNumPartitions() > 1


def test_no_training_runs_in_one_task(spark, monkeypatch):
    parts, train = [], lbl.train
    monkeypatch.setattr(lbl, "WARM", 2)
    monkeypatch.setattr(lbl, "train", lambda texts, *rest: (parts.append(texts.rdd.getNumPartitions()), train(texts, *rest))[1])
    docs = spark.createDataFrame(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), "doc_id long, text string").repartition(4)
    assert lbl.scores(docs).count() == docs.count() and min(parts) > 1
