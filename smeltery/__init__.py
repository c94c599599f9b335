"""Retail medallion analytics (bronze, silver, gold) and query-log analytics on PySpark."""
