"""trackloom: trajectory analytics expressed as Spark DataFrame operators."""
