"""Longer flows put together from the operators: task generators and whole jobs."""
