"""Quality of all documents; labels of a fifth of the ids are held out."""

from pyspark.sql import functions as F

from skuforge.llm import common
from skuforge.llm.quality_fm import held_out, scores, train

NAME = "op7_quality_fm"
SQL = None
FOLDS, FOLD, ACCEPT = 5, 0, 0.3


def fitted(spark, docs, sf_dir):
    labels = common.table(spark, sf_dir, "labels")
    return train(docs, labels.filter(~held_out("doc_id", FOLDS, FOLD)))


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scores(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
