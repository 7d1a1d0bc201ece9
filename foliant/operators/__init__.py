"""Relational operators of the index: DataFrame in, DataFrame out."""
