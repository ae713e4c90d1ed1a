"""Column builders (Catalyst) and numpy kernels (Arrow)."""
