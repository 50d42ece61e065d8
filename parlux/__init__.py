"""parlux: a PySpark-native engine for photo collections, image bytes and media containers."""
