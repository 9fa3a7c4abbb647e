"""Helixion: a PySpark-native engine for sequence (k-mer) analytics and corpus preparation."""
