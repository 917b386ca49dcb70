"""Spark operators for catalog text, retrieval, SQL-text and query-log data."""
