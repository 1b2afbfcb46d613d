"""DataFrame-to-DataFrame operators, keyed by project."""
