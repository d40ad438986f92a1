"""A PySpark-native engine for ranked retrieval over structured documents, its evaluation and its logs."""
