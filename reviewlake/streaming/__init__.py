"""streaming of reviewlake."""
