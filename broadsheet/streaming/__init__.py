"""Structured Streaming forms of the folder watch and the stage report."""
