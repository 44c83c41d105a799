"""Reads, relations and writes over versioned logs, as DataFrame transformations."""
