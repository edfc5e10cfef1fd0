"""PySpark-native analytics over scholarly-document corpora and event logs."""
