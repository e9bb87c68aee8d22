"""News-archive analytics on PySpark: URL keys, rollups, text trends, search."""
