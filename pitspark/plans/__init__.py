"""Compositions of operators into whole jobs, and the queries the driver runs."""
