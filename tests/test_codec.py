import struct

import pytest

from curatrix.operators import codec
from curatrix.plans import queries


def riff(*parts, magic=b"RIFF", kind=b"WAVE", order="<"):
    body = kind + b"".join(i + struct.pack(f"{order}I", len(b)) + b + b"\0" * (len(b) % 2) for i, b in parts)
    return magic + struct.pack(f"{order}I", len(body)) + body


def aiff(*parts):
    return riff(*parts, magic=b"FORM", kind=b"AIFF", order=">")


def names(data, big=False):
    return [c.id for c in codec.chunks(data, big)]


OLD_INFO = (b"LIST", b"INFOINAM\x04\0\0\0old\0")


@pytest.mark.parametrize("parts", [[(b"fmt ", b"x" * 16), (b"data", b"12345")], [(b"data", b"1234"), OLD_INFO, (b"id3 ", b"zz"), (b"smpl", b"loop")], [OLD_INFO, (b"data", b"12")], [(b"data", b"12"), (b"LIST", b"ab")]])
def test_wav(parts):
    new = codec.write_wav(riff(*parts), "Ärt", "Title (Mix)")
    assert names(new).count(b"LIST") == 1
    assert names(new)[-1] == b"LIST"
    assert b"id3 " not in names(new)
    assert struct.unpack_from("<I", new, 4)[0] == len(new) - 8
    assert codec.read_tags(new) == ("Ärt", "Title (Mix)")
    kept = [c for c in codec.chunks(new, False) if c.id == b"data"]
    assert new[kept[0].pos + 8 : kept[0].pos + 8 + kept[0].size] == dict(parts)[b"data"]
    assert codec.write_wav(new, "Ärt", "Title (Mix)") == new


def test_wav_without_artist():
    assert codec.read_tags(codec.write_wav(riff((b"data", b"12")), "", "T")) == ("", "T")


@pytest.mark.parametrize("parts", [[(b"SSND", b"123")], [(b"SSND", b"1234"), (b"ID3 ", b"old")], [(b"ID3 ", b"old!"), (b"SSND", b"12")]])
def test_aiff(parts):
    new = codec.write_aiff(aiff(*parts), "A", "T")
    assert names(new, True).count(b"ID3 ") == 1
    assert codec.read_tags(new) == ("A", "T")
    assert struct.unpack_from(">I", new, 4)[0] == len(new) - 8


def test_mp3_in_place_or_rewritten():
    audio = b"\xff\xfb" + b"a" * 50
    first = codec.write_mp3(audio, "Artist", "Title")
    assert first.endswith(audio) and codec.read_tags(first) == ("Artist", "Title")
    again = codec.write_mp3(first, "Art", "Ti")
    assert len(again) == len(first) and again.endswith(audio) and codec.read_tags(again) == ("Art", "Ti")
    longer = codec.write_mp3(first, "Artist " * 9, "Title")
    assert longer.endswith(audio) and len(longer) > len(first)
    footer = first[:5] + b"\x10" + first[6:]
    assert codec.id3_length(footer) == codec.id3_length(first) + 10


def test_sizes():
    assert codec.synchsafe(257) == b"\0\0\x02\x01"
    assert codec.unsynchsafe(codec.synchsafe(123456)) == 123456
    assert codec.read_tags(b"") is None and codec.read_tags(b"RIFF") is None


def comments(*texts):
    body = struct.pack("<I", 3) + b"me!" + struct.pack("<I", len(texts))
    return body + b"".join(struct.pack("<I", len(x.encode())) + x.encode() for x in texts)


def flac(body):
    block = lambda kind, b: bytes([kind]) + len(b).to_bytes(3, "big") + b
    return b"fLaC" + block(0, b"s" * 34) + block(4, body) + block(0x81, b"\0" * 9) + b"audio"


def ogg(*packets, serial=b"abcd"):
    """A page for each packet, or several if it takes more than 255 segments."""
    out = b""
    for p in packets:
        sizes = [255] * (len(p) // 255) + [len(p) % 255]
        while sizes:
            now, sizes = sizes[:255], sizes[255:]
            body, p = p[: sum(now)], p[sum(now) :]
            out += b"OggS\0\0" + b"g" * 8 + serial + b"n" * 4 + b"c" * 4 + bytes([len(now)]) + bytes(now) + body
    return out


def atom(name, *bodies):
    return struct.pack(">I4s", 8 + sum(map(len, bodies)), name) + b"".join(bodies)


def mp4(artist, title, wide=False):
    value = lambda name, x: atom(name, atom(b"data", struct.pack(">II", 1, 0), x.encode()))
    items = atom(b"ilst", value(b"\xa9nam", title), atom(b"free", b"----"), value(b"\xa9ART", artist))
    moov = atom(b"moov", atom(b"trak", b"x" * 20), atom(b"udta", atom(b"meta", b"\0\0\0\0", atom(b"hdlr", b"h"), items)))
    media = struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"audio" if wide else atom(b"mdat", b"audio")
    return atom(b"ftyp", b"M4A ") + media + moov


READABLE = {
    "flac": flac(comments("TITLE=Ölig", "artist=Vé", "ARTIST=second")),
    "flac behind a tag": codec.id3_tag("no", "no") + flac(comments("Title=Ölig", "Artist=Vé")),
    "vorbis": ogg(b"\x01vorbis...", b"\x03vorbis" + comments("X=" + "y" * 70_000, "ARTIST=Vé", "TITLE=Ölig"), b"\x05vorbis"),
    "opus": ogg(b"OpusHead", b"OpusTags" + comments("TITLE=Ölig", "ARTIST=Vé")),
    "mp4": mp4("Vé", "Ölig"),
    "mp4, wide": mp4("Vé", "Ölig", True),
}


@pytest.mark.parametrize("kind", READABLE)
def test_other_formats_are_read(kind):
    assert codec.read_tags(READABLE[kind]) == ("Vé", "Ölig")


@pytest.mark.parametrize("kind", READABLE)
def test_cut_files_are_no_failure(spark, kind):
    data = READABLE[kind]
    cuts = [(data[:n],) for n in sorted({*range(0, min(len(data), 160)), len(data) // 2, len(data) - 1})]
    rows = spark.createDataFrame(cuts, "content binary").coalesce(1).select(codec.tags_of("content").alias("t"))
    assert rows.count() == len(cuts)


def frame(name, body, size=None, flags=b"\0\0"):
    n = len(body) if size is None else size
    return name + (n.to_bytes(3, "big") if len(name) == 3 else n.to_bytes(4, "big") + flags) + body


@pytest.mark.parametrize(
    "version, flags, body",
    [
        (2, 0, frame(b"TT2", b"\0T\xedtle\0") + frame(b"TP1", b"\x01\xff\xfeA\0")),
        (3, 0, frame(b"TPE1", b"\x01\xff\xfeA\0") + frame(b"XXXX", b"??") + frame(b"TIT2", b"\0T\xedtle")),
        (3, 0x40, (6).to_bytes(4, "big") + b"e" * 6 + frame(b"TPE1", b"\0A") + frame(b"TIT2", b"\0T\xedtle")),
        (4, 0x40, codec.synchsafe(6) + b"ee" + frame(b"TPE1", b"\x03A") + frame(b"TIT2", b"\x03T\xc3\xadtle\0more")),
        (3, 0x80, frame(b"TIT2", b"\0T\xedtle") + frame(b"TPE1", b"\x01\xff\0\xfeA\0", 5)),
        (4, 0, frame(b"TIT2", b"\0T\xedtle", flags=b"\0\0") + frame(b"TPE1", codec.synchsafe(5) + b"\x01\xff\0\xfeA\0", flags=b"\0\x03")),
    ],
)
def test_versions_of_front_tags(version, flags, body):
    if flags & 0x80:  # sizes of frames are those without added zeros, as the whole tag had them added
        body = body.replace(b"\xff\0\xfe", b"\xff\xfe").replace(b"\xff", b"\xff\0")
    tag = b"ID3" + bytes([version, 0, flags]) + codec.synchsafe(len(body)) + body
    assert codec.read_tags(tag + b"audio") == ("A", "Títle")


def test_errors_and_statuses(spark):
    rows = [("/x/A - T.wav", riff((b"data", b"12"))), ("/x/A - T.mp3", b"abc"), ("/x/B - T.wav", b"not riff at all"), ("/x/C.flac", b""), ("/x/ - .mp3", b""), ("/x/D - T.aif", b"x")]
    got = {r.path: r for r in codec.tag_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {p: r.status for p, r in got.items()} == {"/x/A - T.wav": "ok", "/x/A - T.mp3": "ok", "/x/B - T.wav": "error", "/x/C.flac": "skip-ext", "/x/ - .mp3": "skip-noname", "/x/D - T.aif": "error"}
    assert got["/x/B - T.wav"].error and got["/x/A - T.wav"].error is None
    tags = spark.createDataFrame([(bytes(got["/x/A - T.wav"].content),), (None,), (b"junk",)], "content binary").select(codec.tags_of("content").alias("t")).select("t.*")
    assert [tuple(r) for r in tags.collect()] == [("A", "T"), (None, None), (None, None)]


def test_queries_pass_whole_texts_and_all_files(spark, tmp_path, monkeypatch):
    texts = {i: t for i, t in enumerate(["a", "é" * 33, "x" * 41, "word " * 200_000, "é" * 70_001, "z" * 300_000, "y" * 7, "", "k" * 9])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = [], codec.tag_files
    monkeypatch.setattr(codec, "tag_files", lambda files: seen.append(files) or real(files))
    tagged = {int(r.path.split("/")[2]): r for r in queries.q36_tag_roundtrip(spark, str(tmp_path)).collect()}
    assert {i: r.status for i, r in tagged.items()} == {0: "ok", 1: "ok", 2: "ok", 3: "error", 4: "skip-ext", 5: "skip-noname", 6: "ok", 8: "ok"}
    assert all((r.artist, r.title) == ((f"Artist {i}", f"Song {i}") if r.status == "ok" else (None, None)) for i, r in tagged.items())
    files = {r.doc_id: bytes(r.content) for r in seen[0].collect()}
    assert sorted(files) == sorted(tagged) and all(texts[i].encode() in data for i, data in files.items() if i != 3)
    sizes = {}
    for r in queries.q35_chunk_table(spark, str(tmp_path)).collect():
        sizes.setdefault(r.doc_id, []).append((r.id, r.size))
    assert {i: [x for x in found if x[0] in ("data", "SSND")] for i, found in sizes.items()} == {i: [("SSND" if i % 3 else "data", len(texts[i].encode()))] for i in (0, 1, 4, 6)}
    assert len(sizes[1]) == 2  # its old tag stands in front
