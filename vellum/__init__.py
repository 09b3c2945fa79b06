"""Document analytics on Spark: structure, chunks, retrieval, sheets and read-only SQL."""
