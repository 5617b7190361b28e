"""Token counts of all documents."""

import public_tokenizers

from skuforge.llm import common
from skuforge.llm.token_count import token_counts

NAME = "op1_token_counts"
SQL = None


def run(spark, sf_dir):
    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
