"""Where records, edges and mutations come from and go to."""
