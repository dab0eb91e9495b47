"""Linking of streams."""
