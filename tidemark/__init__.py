"""Anomaly analytics over ordered symbol sequences and score streams, as DataFrame operators."""
