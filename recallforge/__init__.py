"""recallforge: memory-store analytics expressed as Spark DataFrame plans."""
