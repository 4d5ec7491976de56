"""DataFrame operators of the coastal library."""
