"""Part of the plumbline analytics engine."""
