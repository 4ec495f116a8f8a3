"""Warranty, claim and spare-part analytics as functions on Spark DataFrames."""
