"""tessel: a Spark-first engine for semantic retrieval and vector time-series."""
