"""Streaming of wavelath."""
