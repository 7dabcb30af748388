"""sources of reviewlake."""
