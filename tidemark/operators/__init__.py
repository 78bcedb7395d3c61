"""Operators over ordered, per-symbol data, as DataFrame functions."""
