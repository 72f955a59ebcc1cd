"""Evaluation analytics over long prediction tables, expressed as Spark DataFrames."""
