"""Document-evidence analytics as Spark jobs."""
