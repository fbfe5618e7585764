"""Readers, file listings, stored tables and writers."""
