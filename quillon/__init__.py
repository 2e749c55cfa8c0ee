"""quillon: a PySpark-native analytics engine (SQL operators, vertex programs, sequence assembly)."""
