"""Readers of tile folders, configuration text and TIFF headers."""
