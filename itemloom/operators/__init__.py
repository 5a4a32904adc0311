"""Operators over items, collections, metadata, annotations and profiles; each takes and returns DataFrames."""
