"""Structured office documents, and text corpora, as Spark DataFrames."""
