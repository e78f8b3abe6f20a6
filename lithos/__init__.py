"""lithos: a PySpark-native engine for documents, records, boxes and annotations."""
