"""Sorted tables, manifests, mutation logs, histories and the fixture views."""
