"""Operators: DataFrame in, DataFrame out, over all clusters at once."""
