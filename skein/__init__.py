"""skein: code and text search analytics expressed as Spark DataFrame plans."""
