"""operators of reviewlake."""
