"""Personal data of all documents."""

from skuforge.llm import common, pii

NAME = "op6_pii"
SQL = None


def run(spark, sf_dir):
    return pii.report(common.table(spark, sf_dir, "documents"))
