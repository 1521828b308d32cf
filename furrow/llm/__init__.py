"""Operators for preparing training text, each built by one stated method."""
