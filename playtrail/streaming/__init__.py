"""File-drop ingest on Structured Streaming."""
