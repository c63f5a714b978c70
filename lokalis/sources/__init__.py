"""Readers of captured tables, screens, pages and answers."""
