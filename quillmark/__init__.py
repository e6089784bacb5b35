"""quillmark: a PySpark-native retrieval and text-memory engine."""
