"""Queries over the driver's tables, one or more per operator family, with their SQL where it can express them."""
