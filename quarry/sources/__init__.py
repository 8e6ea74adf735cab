"""Reading and writing delimited and JSON data."""
