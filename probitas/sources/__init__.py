"""Readers, writers, volume discovery and model runners."""
