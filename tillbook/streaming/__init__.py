"""Summaries kept up to date by streams."""
