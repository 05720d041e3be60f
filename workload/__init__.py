"""Registered queries: the driver's tables read as legal records."""
