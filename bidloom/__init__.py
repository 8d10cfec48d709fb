"""Bid evaluation, rule verdicts and price ranking as Spark DataFrame transformations."""
