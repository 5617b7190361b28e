"""One module per registered query: NAME, run(spark, sf_dir) and SQL (None where SQL cannot express it)."""
