"""PySpark-native text anonymisation, privacy analytics and training-data operators."""
