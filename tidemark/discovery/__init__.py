"""Targets from configuration and source."""
