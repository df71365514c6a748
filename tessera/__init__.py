"""tessera: story analytics expressed as lazily composed Spark DataFrames."""
