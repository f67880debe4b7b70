"""Readers, writers, generators and completion providers."""
