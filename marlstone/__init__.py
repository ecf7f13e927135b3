"""A Spark-first engine for recommendation analytics."""
