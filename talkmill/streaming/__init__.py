"""Streaming jobs: continuous ingest, and chunking of live captions."""

from talkmill.streaming.ingest import logged_transcripts, read_transcript_stream, stream_ingest
from talkmill.streaming.live_chunks import chunk_live_segments, rocksdb_state

__all__ = ["chunk_live_segments", "logged_transcripts", "read_transcript_stream", "rocksdb_state", "stream_ingest"]
