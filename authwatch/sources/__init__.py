"""Readers, ingestion adapters, writers and the synthetic generator."""
