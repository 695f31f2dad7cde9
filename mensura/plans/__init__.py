"""Registered queries: operators bound to the driver's tables, with SQL twins."""
