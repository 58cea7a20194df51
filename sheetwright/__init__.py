"""Spreadsheet and document analytics expressed as Spark DataFrames."""
