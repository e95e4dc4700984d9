"""Compositions of operators: publishing, provenance, verification of runs."""
