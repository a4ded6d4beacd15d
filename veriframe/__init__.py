"""Reconcile versions of hierarchical content inventories with Spark DataFrames."""
