"""Stock-and-flow analytics as Spark DataFrame transformations."""
