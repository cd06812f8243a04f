"""Vehicle-trajectory post-processing and pair-dataset work as Spark jobs."""
