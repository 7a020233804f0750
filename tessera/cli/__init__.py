"""Command lines: convert, export, gen, run_queries."""
