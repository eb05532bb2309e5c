"""A PySpark-native fact-ledger analytics engine."""
