"""strandline: Spark-first interval analytics."""
