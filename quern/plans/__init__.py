"""The catalogue of verification queries."""
