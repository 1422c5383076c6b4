"""Scalar building blocks, as Columns wherever built-in functions suffice."""
