"""Plans as they will run."""
