"""Secrets of all documents."""

from skuforge.llm import common, secret_scan

NAME = "op10_secret_scan"
SQL = None


def run(spark, sf_dir):
    return secret_scan.report(common.table(spark, sf_dir, "documents"))
