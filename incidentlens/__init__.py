"""Spark-native incident evidence analytics: many diagnosis requests, one set of DataFrame jobs."""
