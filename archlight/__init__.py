"""Document-archive analytics on Spark: catalog, selection, statistics, indexes, retrieval."""
