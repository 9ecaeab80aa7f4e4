"""Scalar functions as SQL expressions, written once for Spark and for the SQL they are checked against."""
