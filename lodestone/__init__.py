"""lodestone: a PySpark-native analytics engine."""
