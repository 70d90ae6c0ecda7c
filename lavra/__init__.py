"""Lavra: rule-first, incremental text analytics expressed as Spark DataFrame plans."""
