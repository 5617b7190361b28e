"""Language of all documents; a third of the ids are held out of training."""

from skuforge.llm import common
from skuforge.llm.lang_cnn import predict, train
from skuforge.llm.quality_fm import held_out

NAME = "op5_lang_cnn"
SQL = None
FOLDS, FOLD = 3, 1


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = held_out("doc_id", FOLDS, FOLD)
    return predict(docs.select("doc_id", "text"), train(docs.filter(~out)), keep=[out.alias("held_out")])
