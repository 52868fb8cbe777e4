"""A PySpark-native engine for numerical and machine-learning analytics."""
