"""Play-history analytics expressed as lazy Spark DataFrame operators."""
