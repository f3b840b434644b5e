"""Readers and writers for the file shapes that the engine exchanges."""
