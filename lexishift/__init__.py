"""Audit of data that was written under one set of text rules and is read under another, on Spark."""
