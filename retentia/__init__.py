"""Customer-service analytics as Spark DataFrame transformations."""
