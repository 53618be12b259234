"""Sources of wavelath."""
