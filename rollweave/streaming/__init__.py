"""Streaming forms: online filter, accumulate-until-full, event-time tier."""
