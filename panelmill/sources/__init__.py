"""Readers with declared schemas, and staged writers."""
