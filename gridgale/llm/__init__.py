"""Training-data operators over text tables. Nothing else in the library imports this package."""
