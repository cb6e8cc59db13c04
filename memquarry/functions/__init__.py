"""Part of memquarry."""
