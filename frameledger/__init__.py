"""Frame-dataset curation, evaluation and image analytics as Spark jobs."""
