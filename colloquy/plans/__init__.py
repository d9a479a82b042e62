"""Whole analyses and reports."""
