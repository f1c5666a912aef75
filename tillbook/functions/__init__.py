"""Scalar rules of the reports, each ``Column(s) -> Column``."""
