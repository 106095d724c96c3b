"""Typed scans, staged publishing and content identities."""
