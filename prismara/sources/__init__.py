"""Readers, the snapshot catalogue, ingest."""
