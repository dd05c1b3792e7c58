"""Operators for texts that feed language models."""
