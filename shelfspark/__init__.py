"""Lending-library analytics on PySpark."""
