"""Spark-first analytics over long (ticker, date) panels."""
