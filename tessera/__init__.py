"""Document analytics, retrieval and evaluation as Spark DataFrame plans."""
