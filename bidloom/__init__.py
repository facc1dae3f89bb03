"""Procurement-quotation analytics as PySpark DataFrame operators."""
