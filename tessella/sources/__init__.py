"""Readers of requests, manifests, records and folders."""
