"""Operators on DataFrames: retrieval, chunking, graphs, symbols, history, conversations, telemetry."""
