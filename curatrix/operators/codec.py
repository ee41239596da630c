"""Artist and title tags in the bytes of audio files: reading, writing, tables of chunks.

Tags are written to a front tag of frames (MP3) or to a list of chunks (WAV, AIFF), and read from these
and from the comments of FLAC and Ogg streams and the atoms of MPEG-4 files. Files are binary columns;
nothing is written to disk here.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from curatrix.functions import native
from curatrix.functions import text as t

# fixed values: names in the formats
TITLE_FRAME, ARTIST_FRAME, UTF8_TEXT = b"TIT2", b"TPE1", b"\x03"
OLD_FRAMES = {b"TT2": TITLE_FRAME, b"TP1": ARTIST_FRAME}
ARTIST_INFO, TITLE_INFO = b"IART", b"INAM"
FLAC_COMMENTS, OGG_COMMENTS = 4, (b"\x03vorbis", b"OpusTags")
MP4_WAY, MP4_ARTIST, MP4_TITLE = (b"moov", b"udta", b"meta", b"ilst"), b"\xa9ART", b"\xa9nam"
#: Magic, version, revision, flags, size.
ID3_HEAD = struct.Struct(">3sBBB4s")


class TagError(ValueError):
    """The bytes are not what the file's name says."""


def synchsafe(n: int) -> bytes:
    """28 bits, 7 in each byte."""
    return (n & 0x7F | (n & 0x3F80) << 1 | (n & 0x1FC000) << 2 | (n & 0xFE00000) << 3).to_bytes(4, "big")


def unsynchsafe(b: bytes) -> int:
    n = int.from_bytes(b, "big")
    return n & 0x7F | (n & 0x7F00) >> 1 | (n & 0x7F0000) >> 2 | (n & 0x7F000000) >> 3


def id3_tag(artist: str, title: str, length: int | None = None) -> bytes:
    """A version 2.4 tag with a title and, if there is one, an artist; zeros fill it up to ``length``."""
    frames = bytearray()
    for name, value in ((TITLE_FRAME, title), (ARTIST_FRAME, artist)):
        if value or name == TITLE_FRAME:
            text = UTF8_TEXT + value.encode("utf-8") + bytes(1)
            frames += struct.pack(">4s4s2x", name, synchsafe(len(text))) + text
    if length:
        frames += bytes(max(0, length - ID3_HEAD.size - len(frames)))
    return ID3_HEAD.pack(b"ID3", 4, 0, 0, synchsafe(len(frames))) + frames


def id3_length(data: bytes) -> int:
    """Bytes of the tag in front: its header, its body, and its footer if it says so."""
    if len(data) < ID3_HEAD.size:
        return 0
    magic, _, _, flags, size = ID3_HEAD.unpack_from(data)
    ends = 2 if flags & 0x10 else 1
    return ends * ID3_HEAD.size + unsynchsafe(size) if magic == b"ID3" else 0


def write_mp3(data: bytes, artist: str, title: str) -> bytes:
    """The tag goes over the old one if it fits there, so that the audio stays in place."""
    old = id3_length(data[:10])
    new = id3_tag(artist, title)
    if old >= len(new):
        new = id3_tag(artist, title, old)
        return new + data[len(new) :]
    return new + data[old:]


@dataclass(frozen=True)
class Chunk:
    id: bytes
    pos: int
    size: int

    def end(self) -> int:
        return self.pos + 8 + self.size + self.size % 2


def chunks(data: bytes, big_endian: bool) -> list[Chunk]:
    """All chunks behind the 12 bytes of the file's header; what is too short for one is left out."""
    if len(data) < 12:
        raise TagError(f"a header has 12 bytes, not {len(data)}")
    head, out, at = struct.Struct(">4sI" if big_endian else "<4sI"), [], 12
    while at + head.size < len(data):
        name, size = head.unpack_from(data, at)
        out.append(Chunk(name, at, size))
        at = out[-1].end()
    return out


def chunk(name: bytes, body: bytes, order: str, terminated: bool = False) -> bytes:
    """A chunk of an even number of bytes; the size of a terminated text counts its zeros."""
    padded = body + bytes(len(body) % 2)
    return struct.pack(f"{order}4sI", name, len(padded if terminated else body)) + padded


def info_chunk(artist: str, title: str) -> bytes:
    texts = [chunk(name, value.encode() + bytes(1), "<", terminated=True) for name, value in ((ARTIST_INFO, artist), (TITLE_INFO, title)) if value]
    return chunk(b"LIST", b"INFO" + b"".join(texts), "<")


def is_stale(data: bytes, c: Chunk) -> bool:
    """Metadata that a new INFO list takes the place of."""
    return c.id == b"id3 " or (c.id == b"LIST" and (c.size < 4 or data[c.pos + 8 : c.pos + 12] == b"INFO"))


def _sized(body: bytes, order: str) -> bytes:
    return body[:4] + struct.pack(f"{order}I", len(body) - 8) + body[8:]


def write_wav(data: bytes, artist: str, title: str) -> bytes:
    """One new INFO list at the end; stale metadata goes, wherever it was."""
    found = chunks(data, False)
    if data[:4] != b"RIFF" or not found:
        raise TagError("no RIFF file with chunks")
    audio = next((i for i, c in enumerate(found) if c.id == b"data"), None)
    if audio is None:
        raise TagError("a WAV file without audio data")
    in_front = any(is_stale(data, c) for c in found[:audio])
    head, rest = (b"RIFF\0\0\0\0WAVE", found) if in_front else (data[: found[audio].end()].ljust(found[audio].end(), b"\0"), found[audio + 1 :])
    kept = b"".join(data[c.pos : c.end()] for c in rest if not is_stale(data, c))
    return _sized(head + kept + info_chunk(artist, title), "<")


def write_aiff(data: bytes, artist: str, title: str) -> bytes:
    """One ID3 chunk at the end; any other goes."""
    found = chunks(data, True)
    if data[:4] != b"FORM":
        raise TagError("no FORM file")
    tag = id3_tag(artist, title)
    if any(c.id == b"ID3 " for c in found[:-1]):
        body = b"FORM\0\0\0\0" + data[8:12] + b"".join(data[c.pos : c.end()] for c in found if c.id != b"ID3 ")
    else:
        body = data[: found[-1].pos] if found and found[-1].id == b"ID3 " else data
    return _sized(body + chunk(b"ID3 ", tag, ">"), ">")


WRITERS: dict[str, Callable[[bytes, str, str], bytes]] = {".wav": write_wav, ".mp3": write_mp3, ".aiff": write_aiff, ".aif": write_aiff, ".aifc": write_aiff}


def tag_bytes(name: str, data: bytes) -> tuple[str, bytes | None]:
    """Status (ok, skip-noname, skip-ext) and the file's new bytes, from its name."""
    write = WRITERS.get(native.splitext(name)[1].lower())
    artist, title = native.parse_name(name)
    if write is None:
        return "skip-ext", None
    if not title:
        return "skip-noname", None
    return "ok", write(data, artist, title)


def _id3_frames(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Names and bodies of a front tag's frames, of versions 2.2 to 2.4."""
    _, version, _, flags, size = ID3_HEAD.unpack_from(data)
    body = data[ID3_HEAD.size : ID3_HEAD.size + unsynchsafe(size)]
    if flags & 0x80 and version < 4:  # zeros were put in where audio could seem to begin
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2 and len(body) >= 4:  # an extended header comes first
        body = body[unsynchsafe(body[:4]) if version >= 4 else 4 + int.from_bytes(body[:4], "big") :]
    name_size, head = (3, 6) if version == 2 else (4, 10)
    at = 0
    while at + head <= len(body) and body[at]:
        raw = body[at + name_size : at + 2 * name_size]
        n = unsynchsafe(raw) if version >= 4 else int.from_bytes(raw, "big")
        frame = body[at + head : at + head + n]
        if version >= 4 and body[at + 9] & 1:  # its length without added zeros comes first
            frame = frame[4:]
        if version >= 4 and (flags & 0x80 or body[at + 9] & 2):
            frame = frame.replace(b"\xff\0", b"\xff")
        yield body[at : at + name_size], frame
        at += head + n


def read_id3(data: bytes) -> tuple[str, str]:
    """Artist and title of a front tag."""
    found: dict[bytes, str] = {}
    for name, frame in _id3_frames(data) if id3_length(data) else ():
        if frame and name in (TITLE_FRAME, ARTIST_FRAME, *OLD_FRAMES):
            kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(frame[0], "utf-8")
            found.setdefault(OLD_FRAMES.get(name, name), frame[1:].decode(kind, "replace").split("\0")[0])
    return found.get(ARTIST_FRAME, ""), found.get(TITLE_FRAME, "")


def read_comments(data: bytes) -> tuple[str, str]:
    """Artist and title of a block of ``NAME=value`` comments, as FLAC and Ogg streams have it."""
    found: dict[str, str] = {}
    at = 4 + struct.unpack_from("<I", data)[0]  # behind the writer's name
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        name, _, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        found.setdefault(name.upper(), value)
        at += 4 + size
    return found.get("ARTIST", ""), found.get("TITLE", "")


def read_flac(data: bytes) -> tuple[str, str]:
    """Of the stream's block of comments; blocks have a kind and a size of 24 bits."""
    at, last = 4, False
    while not last and at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == FLAC_COMMENTS:
            return read_comments(data[at + 4 : at + 4 + size])
        last, at = bool(kind & 0x80), at + 4 + size
    return "", ""


def ogg_packets(data: bytes) -> Iterator[bytes]:
    """Packets of the file's first stream: pages list the sizes of segments; one below 255 ends a packet."""
    at, packet, stream = 0, bytearray(), None
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        serial, n = data[at + 14 : at + 18], data[at + 26]
        sizes, low = data[at + 27 : at + 27 + n], at + 27 + n
        stream = stream or serial
        for size in sizes:
            if serial == stream:
                packet += data[low : low + size]
                if size < 255:
                    yield bytes(packet)
                    packet.clear()
            low += size
        at = low


def read_ogg(data: bytes) -> tuple[str, str]:
    """Of the stream's second packet."""
    for i, packet in enumerate(ogg_packets(data)):
        for mark in OGG_COMMENTS:
            if packet.startswith(mark):
                return read_comments(packet[len(mark) :])
        if i >= 2:
            break
    return "", ""


def _atoms(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Names and bodies: sizes count their heads; 1 means 64 bits behind, 0 up to the end."""
    at = 0
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or len(data) - at
        if size < head:
            raise TagError("an atom smaller than its head")
        yield name, data[at + head : at + size]
        at += size


def read_mp4(data: bytes) -> tuple[str, str]:
    """Of the atoms at ``moov.udta.meta.ilst``."""
    for name in MP4_WAY:
        data = next((body for found, body in _atoms(data) if found == name), b"")
        if name == b"meta":
            data = data[4:]  # version and flags
    texts = {}
    for name, body in _atoms(data):
        # A value has its type and language in front.
        texts[name] = next((value[8:].decode("utf-8", "replace") for kind, value in _atoms(body) if kind == b"data"), "")
    return texts.get(MP4_ARTIST, ""), texts.get(MP4_TITLE, "")


def read_chunks(data: bytes) -> tuple[str, str]:
    """Of a WAV or AIFF file: its ID3 chunk if that says something, else its first INFO list."""
    info, tag = ("", ""), ("", "")
    for c in chunks(data, data[:4] == b"FORM"):
        body = data[c.pos + 8 : c.pos + 8 + c.size]
        if c.id == b"LIST" and body[:4] == b"INFO" and not any(info):
            texts, at = {}, 4
            while at + 8 <= len(body):
                name, size = struct.unpack_from("<4sI", body, at)
                texts[name] = body[at + 8 : at + 8 + size].rstrip(b"\0").decode("utf-8", "replace")
                at += 8 + size + size % 2
            info = texts.get(ARTIST_INFO, ""), texts.get(TITLE_INFO, "")
        elif c.id in (b"ID3 ", b"id3 "):
            tag = read_id3(body) if any(read_id3(body)) else tag
    return tag if any(tag) else info


def read_tags(data: bytes) -> tuple[str, str] | None:
    """Artist and title of any of the formats, or None where both are empty or nothing can be read."""
    front = id3_length(data)
    if data[:4] in (b"RIFF", b"FORM") and len(data) >= 12:
        pair = read_chunks(data)
    elif data[front : front + 4] == b"fLaC":
        pair = read_flac(data[front:])
        pair = pair if any(pair) else read_id3(data)
    elif data[:4] == b"OggS":
        pair = read_ogg(data)
    elif data[4:8] == b"ftyp":
        pair = read_mp4(data)
    else:
        pair = read_id3(data)
    return pair if any(pair) else None


def tag_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as path, status, content (new bytes), error: a bad file fails no task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    status, new = tag_bytes(r.path.replace("\\", "/").rpartition("/")[2], bytes(r.content))
                    rows.append((r.path, status, new, None))
                except (TagError, struct.error) as e:
                    rows.append((r.path, "error", None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "status", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, status string, content binary, error string")


@pandas_udf(T.StructType([T.StructField("artist", T.StringType()), T.StructField("title", T.StringType())]))
def tags_of(content: pd.Series) -> pd.DataFrame:
    """Embedded artist and title; both null where there are none."""
    rows = []
    for data in content:
        try:
            rows.append((None if data is None else read_tags(bytes(data))) or (None, None))
        except (TagError, struct.error):
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["artist", "title"])


@pandas_udf(T.IntegerType())
def part_count(content: pd.Series) -> pd.Series:
    """How many chunks a RIFF or IFF file has; any other is one part."""
    out = []
    for data in content:
        head = b"" if data is None else bytes(data[:4])
        out.append(None if data is None else len(chunks(bytes(data), head == b"FORM")) if head in (b"RIFF", b"FORM") else 1)
    return pd.Series(out, dtype="Int32")


@udtf(returnType=T.StructType([T.StructField("id", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("size", T.LongType())]))
class ChunkTable:
    """The chunks of a RIFF or IFF file, one row each."""

    def eval(self, content: bytes):  # noqa: ANN201
        if content is None or len(content) < 12 or bytes(content[:4]) not in (b"RIFF", b"FORM"):
            return
        for c in chunks(bytes(content), bytes(content[:4]) == b"FORM"):
            yield c.id.decode("latin-1"), c.pos, c.size


def predicted_status(name):  # noqa: ANN001, ANN201
    """What tagging a file of this name would do, as a column, without reading it."""
    title = t.parse_name(name)[1]
    return F.when(~t.has_extension(name, t.TAG_EXTENSIONS), "skip-ext").when(title == "", "skip-noname").otherwise("ok")


def tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
