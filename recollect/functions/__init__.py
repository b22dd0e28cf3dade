"""Part of the recollect engine."""
