"""Readers and parsers that turn files and tables into section rows."""
