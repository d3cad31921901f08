"""inciflow: cosmetic formula analytics as Spark DataFrame and streaming jobs."""
