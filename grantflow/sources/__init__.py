"""Readers for catalogs and landed files."""
