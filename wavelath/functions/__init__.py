"""Functions of wavelath."""
