"""Composed jobs, and the registered checks over the driver's tables."""
