"""Training-data operators. Nothing else in lumbria imports this subpackage."""
