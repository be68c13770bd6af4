"""Operators on long tables: DataFrame in, DataFrame out. Key, order and value columns are parameters."""
