"""revlens: review analytics and model evaluation as Spark jobs."""
