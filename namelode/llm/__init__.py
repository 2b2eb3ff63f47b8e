"""Operators of large-scale text and name data; nothing outside this package imports it."""
