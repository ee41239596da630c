"""The few name rules that Python code on executors needs too."""

from __future__ import annotations


def splitext(name: str) -> tuple[str, str]:
    """Root and extension; leading dots begin no extension."""
    dots = len(name) - len(name.lstrip("."))
    at = name.rfind(".", dots)
    return (name, "") if at < 0 else (name[:at], name[at:])


def parse_name(name: str) -> tuple[str, str]:
    """Artist and title of ``Artist - Title.ext``."""
    artist, dash, title = splitext(name)[0].partition(" - ")
    return (artist.strip(), title.strip()) if dash else ("", artist.strip())
