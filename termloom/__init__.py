"""Document/posting matching expressed as Spark DataFrame jobs."""
