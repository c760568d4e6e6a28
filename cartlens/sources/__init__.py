"""Schemas, driver-table mapping, writers and readers."""
