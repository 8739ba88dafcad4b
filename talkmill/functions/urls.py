"""URL and page functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.text import col, let

NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
# Fixed value: where a link holds the id of a video.
YOUTUBE_ID = r"(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]+)"

# How share pages carry their media link and title, in order of trust.
MEDIA_PATTERNS = [
    (r'"videoUrl":"([^"]+)"', 1),
    (r'"url":"([^"]*\.mp4[^"]*)"', 1),
    (r'"video_url":"([^"]+)"', 1),
    (r'"src":"([^"]*\.mp4[^"]*)"', 1),
    (r'https://[^"]*\.mp4[^"]*', 0),
]
TITLE_PATTERNS = [r'"title":"([^"]+)"', r'"name":"([^"]+)"', r"<title>([^<]+)</title>"]


def _hit(s: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def route_source(url: Column | str) -> Column:
    """``loom`` when the host name occurs anywhere in the URL, else ``youtube``."""
    return F.when(F.lower(col(url)).contains("loom.com"), "loom").otherwise("youtube")


def netloc(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), NETLOC, 1))


def is_youtube_host(url: Column | str) -> Column:
    return let(netloc(url), lambda h: h.contains("youtube.com") | h.contains("youtu.be"))


def is_loom_host(url: Column | str) -> Column:
    return netloc(url).contains("loom.com")


def youtube_video_id(url: Column | str) -> Column:
    return _hit(col(url), YOUTUBE_ID)


def loom_video_id(url: Column | str) -> Column:
    """Last path part; null unless the path has at least two parts."""
    path = F.regexp_replace(F.regexp_extract(col(url), PATH, 1), ";[^/]*$", "")
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    return let(parts, lambda p: F.when(F.size(p) >= 2, F.element_at(p, -1)))


def canonical_video_id(url: Column | str) -> Column:
    """One id per video whatever the share suffix (used for optional de-duplication)."""
    return F.coalesce(youtube_video_id(url), loom_video_id(url), col(url))


def namespace_of(company: Column | str) -> Column:
    return F.replace(F.lower(col(company)), F.lit(" "), F.lit("-"))


def vector_id(company: Column | str, video_url: Column | str, chunk_index: Column | str) -> Column:
    """``company_url_index`` from the raw values (null parts count as empty)."""
    part = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    return F.concat(part(company), F.lit("_"), part(video_url), F.lit("_"), part(chunk_index))


def page_media_url(html: Column | str) -> Column:
    """First hit that is an absolute link, else the last hit of any kind."""
    html = col(html)
    hits = F.array(*[_hit(html, p, g) for p, g in MEDIA_PATTERNS])
    found = F.array_compact(hits)
    return let(
        found,
        lambda f: F.coalesce(
            F.get(F.filter(f, lambda u: u.startswith("http")), F.lit(0)),
            F.try_element_at(f, F.lit(-1)),
        ),
    )


def page_title(html: Column | str) -> Column:
    """First title hit, null when the page has none."""
    return F.coalesce(*[_hit(col(html), p) for p in TITLE_PATTERNS])
