"""Patent screening and prior-art analytics as Spark DataFrame jobs."""
