"""Resumable append jobs on Structured Streaming."""
