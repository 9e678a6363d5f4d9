"""feedloom: content-curation analytics as PySpark DataFrame jobs."""
