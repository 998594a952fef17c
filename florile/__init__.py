"""Florile: catalog search, curation and de-duplication on PySpark DataFrames."""
