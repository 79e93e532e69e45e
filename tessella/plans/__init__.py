"""Placement strategies and the job as a whole."""
