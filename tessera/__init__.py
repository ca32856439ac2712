"""tessera: document retrieval and analytics operators as PySpark plans."""
