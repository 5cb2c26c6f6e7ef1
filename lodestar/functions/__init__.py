"""Column functions: metrics, vector arithmetic, validation."""
