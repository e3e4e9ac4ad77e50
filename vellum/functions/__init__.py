"""Part of the static-quality engine."""
