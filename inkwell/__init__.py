"""Inkwell: search, merge and report over a large article archive, as Spark plans."""
