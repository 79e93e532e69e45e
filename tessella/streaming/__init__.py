"""The same operators on unbounded catalogs."""
