"""Whole analyses: routing, the command line, and the queries over the driver's tables."""
