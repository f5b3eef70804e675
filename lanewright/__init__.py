"""Lane-level road-map analytics as Spark DataFrame computations."""
