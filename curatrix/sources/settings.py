"""Settings of an application around the library."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from curatrix.operators.naming import Options


@dataclass(frozen=True)
class Settings:
    """``max_threads`` is read and kept only: how many tasks run at a time is the session's."""

    last_folder: str | None = None
    master_db: str | None = None
    backup_dir: str | None = None
    duplicates_dir: str | None = None
    alphabetical_artists: bool = True
    prefer_tags: bool = True
    set_title: bool = True
    refresh_artist: bool = True
    max_threads: int = 0

    def naming(self) -> Options:
        """The mix of a file's name is always kept."""
        return Options("tags" if self.prefer_tags else "filename", self.alphabetical_artists, True)

    def relink(self) -> dict[str, bool]:
        """What ``collection.apply_relink`` takes."""
        return {"set_title": self.set_title, "refresh_artist": self.refresh_artist}


def load_settings(path: str) -> Settings:
    """Of a JSON file; what it lacks, or all if it can't be read, has its default."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return Settings()
    known = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in found.items() if k in known}) if isinstance(found, dict) else Settings()
