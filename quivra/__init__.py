"""Quivra: vector search over versioned data, expressed as Spark DataFrames."""
