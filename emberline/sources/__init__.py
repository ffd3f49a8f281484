"""Where alerts and techniques come from."""
