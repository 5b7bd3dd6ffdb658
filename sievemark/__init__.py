"""Sievemark: text security scanning, anonymization and analytics on Spark DataFrames."""
