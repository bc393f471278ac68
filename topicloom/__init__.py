"""Topic discovery and text analytics as Spark DataFrame jobs."""
