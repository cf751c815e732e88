"""Vendor-risk analytics as Spark jobs over whole vendor portfolios."""
