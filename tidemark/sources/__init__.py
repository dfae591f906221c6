"""Reading archives, tables and JSON files; writing results."""
