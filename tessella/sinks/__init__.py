"""Writers of tiles, levels and records."""
