"""A PySpark-native engine that matches books against award archives and prepares large text corpora."""
