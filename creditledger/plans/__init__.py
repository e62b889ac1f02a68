"""Whole reports and the queries registered with the driver."""
