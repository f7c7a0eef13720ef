"""Readers and writers for the domain tables."""
