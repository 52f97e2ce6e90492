"""Sequence, graph and corpus analytics expressed on PySpark DataFrames."""
