"""Operators over segments, texts, timelines and audio."""
