"""Repository and event analytics on Spark."""
