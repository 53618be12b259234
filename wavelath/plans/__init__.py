"""Plans of wavelath."""
