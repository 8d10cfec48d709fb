"""Registered queries: engine operators applied to the driver's tables."""
