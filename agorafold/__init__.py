"""Agorafold: social-content analytics as Spark DataFrame plans."""
