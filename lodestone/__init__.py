"""A PySpark-native engine for source-aware catalog graphs and corpus preparation."""
