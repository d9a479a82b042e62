"""Stateful operators over streams, with their batch counterparts."""
