"""Readers. Each takes a path (or a table already read) and declares its schema."""

from talkmill.sources.log_source import read_logs, register_logs
from talkmill.sources.readers import (
    parse_transcript_logs,
    scan_asr_segments,
    scan_caption_items,
    scan_pages,
    scan_qa_pairs,
    scan_questions,
    scan_transcript_logs,
    scan_vectors,
    scan_video_registry,
    stream_transcript_logs,
)

__all__ = [
    "parse_transcript_logs",
    "read_logs",
    "register_logs",
    "scan_asr_segments",
    "scan_caption_items",
    "scan_pages",
    "scan_qa_pairs",
    "scan_questions",
    "scan_transcript_logs",
    "scan_vectors",
    "scan_video_registry",
    "stream_transcript_logs",
]
