"""Readers, writers, manifests and the observation table."""
