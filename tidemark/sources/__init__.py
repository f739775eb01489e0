"""Where frames, limits and models are read from and written to."""
