"""Point-in-time equity analytics expressed as Spark DataFrame plans."""
