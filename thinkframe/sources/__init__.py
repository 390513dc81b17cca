"""Readers: raw examples, benchmark files, run summaries, family dimensions,
and the derived fixture views over the driver tables."""
