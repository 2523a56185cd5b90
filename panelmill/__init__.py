"""Panel and time-series analytics as composable Spark DataFrame transformations."""
