"""Spanfold: transaction scoring and exact nearest-neighbour analytics on PySpark DataFrames."""
