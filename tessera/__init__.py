"""tessera: document intelligence and retrieval operators for PySpark."""
