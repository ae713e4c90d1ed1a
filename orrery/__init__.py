"""A Spark-first engine for multivariate time-series and trajectory analytics."""
