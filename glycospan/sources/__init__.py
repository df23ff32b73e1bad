"""Readings in, tables out."""
