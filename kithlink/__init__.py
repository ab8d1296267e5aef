"""Spark-native record linkage and analytics: lazy DataFrame plans from raw entities to matched ids."""
