"""Readers and importers: files, manifests, findings, rules."""
