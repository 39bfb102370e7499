"""Part of the price analytics engine."""
