"""Whole plans made up of operators, and the catalogue of queries."""
