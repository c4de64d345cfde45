"""Analytics and retrieval over large text corpora, on Spark DataFrames."""
