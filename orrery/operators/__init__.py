"""Relational and kernel-backed operators: one module per family."""
