"""Training-data operators; nothing else in frostline imports this subpackage."""
