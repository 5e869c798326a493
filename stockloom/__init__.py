"""Retail demand analytics expressed as Spark DataFrame operators and jobs."""
