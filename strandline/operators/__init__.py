"""Relational operators; every one is a function DataFrame -> DataFrame."""
