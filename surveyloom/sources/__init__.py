"""Readers, load audit, exports and snapshots."""
