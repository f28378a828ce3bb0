"""Where tables come from and where their new versions go."""
