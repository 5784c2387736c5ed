"""Spark-native data consistency engine: profiling, relation discovery, rules, violations and repairs as DataFrames."""
