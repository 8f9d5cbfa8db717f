"""sieveline: retrieval, evidence and corpus-preparation analytics on PySpark DataFrames."""
