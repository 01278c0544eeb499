"""Whole requests, composed from operators."""
