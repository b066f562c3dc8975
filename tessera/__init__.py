"""Tessera: text retrieval, corpus curation and event journals on Spark DataFrames."""
