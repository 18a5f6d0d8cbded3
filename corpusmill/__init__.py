"""A PySpark-native engine for building and analysing multilingual text corpora."""
