"""Streaming form of the stateless review (filter + rules), to files or with the effects of the sinks."""

from .review_stream import append_batch, review_stream, review_stream_append, review_stream_frame

__all__ = ["append_batch", "review_stream", "review_stream_append", "review_stream_frame"]
