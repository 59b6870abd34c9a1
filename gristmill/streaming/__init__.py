"""Workflows over streams of envelopes."""
