"""Spatial cell-graph analytics, and text-corpus operators, as PySpark plans."""
