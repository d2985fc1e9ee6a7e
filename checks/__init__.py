"""Checked queries: each pairs a Spark query over the given tables with SQL for the same answer."""
