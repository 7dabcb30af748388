"""functions of reviewlake."""
