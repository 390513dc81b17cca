"""Registered query plans (Spark side) and their SQL twins."""
