"""Ids of all documents through the table of distinct words, and what they decode to."""

import public_tokenizers

from skuforge.llm import common
from skuforge.llm.word_table import encode_and_decode

NAME = "op12_word_table"
SQL = None


def run(spark, sf_dir):
    return encode_and_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
