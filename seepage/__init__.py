"""Exposure analytics on tables the user already holds, as Spark DataFrame jobs."""
