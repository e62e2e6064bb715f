"""Chunked uploads as a stream."""
