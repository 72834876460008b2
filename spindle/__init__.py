"""Spark-native operational analytics: versioned tables, incremental ingestion, star schemas, metric views and quality gates."""
