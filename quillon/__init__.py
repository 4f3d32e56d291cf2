"""quillon: a PySpark-native engine for document structuring, ranked retrieval and its evaluation."""
