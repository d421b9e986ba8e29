"""Where repositories come from and where results are kept."""
