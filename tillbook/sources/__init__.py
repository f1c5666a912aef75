"""Where the retail tables come from and where summaries are kept."""
