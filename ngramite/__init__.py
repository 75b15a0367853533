"""A PySpark-native n-gram language-model store and its analytics."""
