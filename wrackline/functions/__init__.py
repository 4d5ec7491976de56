"""Constants and column expressions."""
