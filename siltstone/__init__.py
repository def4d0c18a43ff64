"""Evidence-resolution analytics expressed as Spark DataFrame plans."""
