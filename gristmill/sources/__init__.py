"""Inputs and outputs: envelopes, gold data, journals of attempts, reports."""
