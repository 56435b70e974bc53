"""Sources: files and HTTP polling."""
