"""Document-record analytics as set-based Spark jobs."""
