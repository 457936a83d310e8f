"""Operators for preparing training data, each usable alone; nothing else in the package imports them."""
