"""tessera: density clustering of embedding vectors as Spark DataFrame operators."""
