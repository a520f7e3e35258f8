"""A PySpark-native engine for retrieval, access control and rule-driven document processing."""
