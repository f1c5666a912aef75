"""Building blocks the reports share."""
