"""Plans of further queries."""
