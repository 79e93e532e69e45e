"""Writers of pyramids."""
