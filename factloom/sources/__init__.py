"""Scans, payload normalizers and sinks."""
