"""caseloom: a PySpark-native engine for document-centred case data."""
