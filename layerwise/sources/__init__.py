"""Where tables and notebooks come from, and where results go."""
