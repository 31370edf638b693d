"""Interval, window, lifecycle, detection and data-quality analytics as DataFrame operators."""
