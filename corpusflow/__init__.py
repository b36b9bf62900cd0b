"""Document retrieval and text analytics as Spark DataFrame jobs."""
