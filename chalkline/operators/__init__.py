"""Relational and sequential operators over timelines, intervals and events."""
