"""Jobs and the command line."""
