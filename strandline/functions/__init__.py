"""Scalar functions as JVM column expressions, and Arrow functions where none exists."""
