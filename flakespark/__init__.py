"""FlakeSpark: a PySpark-native engine for triaging groups of related test failures."""
