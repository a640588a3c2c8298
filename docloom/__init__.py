"""Document question answering and text analytics as Spark jobs."""
