"""Readers of sensor, label, feature-list, feature-map, baseline and configuration files."""
