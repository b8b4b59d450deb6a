"""Registered queries over the driver's tables, each with SQL for the same result."""
