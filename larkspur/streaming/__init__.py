"""Structured Streaming: file watching, transcript tailing, event-time analytics."""
