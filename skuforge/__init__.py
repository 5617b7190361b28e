"""Catalogue enrichment and data-quality engine on DataFrames; training-corpus operators are in skuforge.llm."""
