"""Operators on relations of tiles and pixels."""
