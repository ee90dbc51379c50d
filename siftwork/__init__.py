"""Spark-native analytics over code structure, risk scores, policy decisions and audit events."""
