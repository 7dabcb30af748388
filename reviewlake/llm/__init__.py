"""Operators for large text corpora: visual form, tokens, packing, chunks, duplicates, linkage, survivorship, abuse."""
