"""strandlake: sequence and interval analytics as Spark DataFrame transformations."""
