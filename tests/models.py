"""Plain loop statements of what the operators compute, used as brute-force checks."""

from talkmill.functions.text import WHITESPACE


def clean(segments, default_end):
    out = []
    for text, start, end in segments:
        text = (text or "").strip(WHITESPACE)
        if text:
            start = 0.0 if start is None else start
            out.append((text, start, default_end(start) if end is None else end))
    return out


def fold(segments, size, cap, compat=True):
    chunks, parts = [], []
    for seg in clean(segments, lambda s: s):
        parts.append(seg)
        length = len(" ".join(p[0] for p in parts))
        first, last = parts[0][1], parts[-1][2]
        span = 0.0 if compat and first == 0 else last - first
        if length >= size or span >= cap:
            chunks.append(parts)
            parts = []
    if parts:
        chunks.append(parts)
    return [
        (" ".join(p[0] for p in c), max(0.0, c[0][1]), max(c[0][1], c[-1][2])) for c in chunks
    ]


def fold_fixed(segments, duration):
    chunks = []
    for seg in clean(segments, lambda s: 0.0):
        if not chunks or seg[1] - chunks[-1][0][1] >= duration:
            chunks.append([])
        chunks[-1].append(seg)
    return [(" ".join(p[0] for p in c), c[0][1], c[-1][2]) for c in chunks]


def windows(text, size, overlap):
    out, pos = [], 0
    while pos < len(text):
        end = pos + size
        if end < len(text):
            low = max(end - 99, pos + 1)
            ends = [i for i in range(low, end + 1) if text[i] in ".!?"]
            if ends:
                end = ends[-1] + 1
        piece = text[pos:end].strip(WHITESPACE)
        if piece:
            out.append(piece)
        pos = end - overlap
    return out
