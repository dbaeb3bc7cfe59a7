"""Document retrieval, table question answering and corpus preparation on Spark."""
