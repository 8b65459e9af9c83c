"""Document retrieval engine on Spark."""
