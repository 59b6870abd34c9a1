"""DataFrame operators over runs and evaluations."""
