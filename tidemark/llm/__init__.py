"""Training-data operators (language ID, near-dedup, tokenisation, ...) built on Spark.

Nothing outside this folder imports it.
"""
