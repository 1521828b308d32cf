"""Structured Streaming forms of resumable scans, composites, status updates and de-duplication."""
