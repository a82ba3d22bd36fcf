"""Features as plans."""
