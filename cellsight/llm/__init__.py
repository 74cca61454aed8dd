"""Training-data operators over whole documents; nothing else in the library imports this package."""
