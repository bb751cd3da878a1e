"""Readers and writers for the result tables."""
