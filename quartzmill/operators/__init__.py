"""Operators on wide or long sensor data."""
