"""Operators for large text corpora: one module for each, bound to the tables in ``queries``."""
