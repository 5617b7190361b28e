"""Byte-level BPE there and back over all documents."""

import public_tokenizers

from skuforge.llm import common
from skuforge.llm.byte_bpe import round_trip

NAME = "op3_byte_bpe"
SQL = None


def run(spark, sf_dir):
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
