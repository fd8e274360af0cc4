"""Registered driver queries."""
