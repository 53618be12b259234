"""Operators of wavelath."""
