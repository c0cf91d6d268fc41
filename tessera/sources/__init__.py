"""Readers of relations."""
