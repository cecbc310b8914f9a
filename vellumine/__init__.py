"""Exploring a catalogue of unlike kinds of item, each result with the source text that supports it; Spark first."""
