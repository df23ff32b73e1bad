"""Independent SQL of the checked queries."""
