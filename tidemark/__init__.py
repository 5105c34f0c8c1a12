"""Tidemark: a PySpark-native engine for cleaning, profiling and analysing large event and text tables."""
