"""Spreadsheet workbooks and cell algebra as Spark DataFrames."""
