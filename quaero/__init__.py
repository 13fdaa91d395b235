"""quaero: retrieval, routing and evaluation analytics as Spark DataFrame jobs."""
