"""Readers that turn foreign files into tables."""
