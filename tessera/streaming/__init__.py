"""Micro-batch ingestion and windowed counters."""
