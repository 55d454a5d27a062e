"""Structured Streaming: a stream of documents' changes into versioned tables."""
