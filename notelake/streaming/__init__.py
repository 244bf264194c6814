"""Streams of note versions and visits; with ``availableNow`` they give what a batch gives."""
