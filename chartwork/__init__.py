"""Distance maps, landscapes and text pipelines as Spark DataFrame jobs."""
