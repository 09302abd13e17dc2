"""Anomaly models."""
