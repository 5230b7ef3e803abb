"""Readers and writers: measurements, cell exports, map features, missions."""
