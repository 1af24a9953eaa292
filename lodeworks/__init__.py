"""Analytics and training-data engine expressed as Spark DataFrame plans."""
