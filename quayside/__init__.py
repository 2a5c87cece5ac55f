"""Analytics over public product feedback, expressed as Spark DataFrame plans."""
