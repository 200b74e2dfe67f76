"""weakspot: a PySpark-native engine for model-weakness analysis."""
