"""A PySpark-native engine for grounded knowledge: lexicons, retrieval, relation graphs, claims, alignment and rules."""
