"""Whole review runs and the catalogue of registered queries."""
