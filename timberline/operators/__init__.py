"""Operators on log lines and log rows: DataFrame in, DataFrame out."""
