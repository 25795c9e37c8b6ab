"""Reusable plan shapes: adjacent rows, fixpoints, bounded listings, pattern joins."""
