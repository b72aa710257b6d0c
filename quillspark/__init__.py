"""A PySpark-native engine for building, cleaning and evaluating evidence-retrieval corpora."""
