"""Screening operators: DataFrame in, DataFrame out, lazily."""
