"""Operators: DataFrame -> DataFrame, or fit -> state and apply(DataFrame, state)."""
