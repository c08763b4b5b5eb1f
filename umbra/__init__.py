"""Umbra: a Spark-native redaction and re-identification engine."""
