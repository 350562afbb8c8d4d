"""speechmill: a PySpark-native analytics engine for dated, attributed text records."""
