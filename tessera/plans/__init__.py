"""Registered queries and the whole pipeline."""
