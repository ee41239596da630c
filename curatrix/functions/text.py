"""Names and paths as column expressions: what cleans, sorts, splits and compares them.

All of it stays in the JVM. Java's patterns need ``(?U)`` for Unicode white space and word limits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions, words that mark a mix, patterns
NAME_EXTENSIONS = (".mp3", ".wav", ".aiff", ".aif", ".flac", ".m4a", ".ogg")
FILE_EXTENSIONS = (*NAME_EXTENSIONS, ".aifc")
TAG_EXTENSIONS = (".wav", ".mp3", ".aiff", ".aif", ".aifc")
MIX_WORDS = ("mix", "remix", "edit", "bootleg", "rework", "version", "vip", "flip", "radio", "extended", "original", "cut", "remaster", "dub", "refix", "mashup", "remake", "anthem", "instrumental")
QUALITY = {".wav": 3, ".aiff": 3, ".aif": 3, ".aifc": 3, ".flac": 3, ".m4a": 1, ".ogg": 1, ".mp3": 1}
FEAT_WORD = r"(?iU)\b(?:feat(?:uring|s)?|ft)\b\.?"
FEAT_SPACED = r"(?iU)\s*\bfeat\.\s*"
FEAT_SPLIT = r"(?iU)\s+feat\.\s+"
TRACK_NUMBER = r"(?U)^(?:0\d[\s_.\-]+|\d{1,2}(?:\.\s+|\s*-\s+|_+))"
LABEL_CODE = r"(?U)\s*-\s*[A-Z]{2,6}\d{2,4}\s*-\s*"
DOUBLED_MIX = r"(?i)(-(?:original|extended|radio)-mix)\1"
FORBIDDEN = r'[\\/:*?"<>|]'
PAREN = r"\([^)]*\)"
_MIX = "(?:" + "|".join(MIX_WORDS) + ")"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), lambda x: f(x)), 1)


def utrim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_junk(c: Column) -> Column:
    """No-break spaces become spaces, control and format characters go, white space is evened out."""
    return one_space(F.regexp_replace(F.regexp_replace(c, r"\xA0", " "), r"\p{C}", ""))


def clean_tag(c: Column) -> Column:
    """As strip_junk, with underscores as spaces: for tags, not for file names."""
    return strip_junk(F.translate(c, "_", " "))


def std_feat(c: Column) -> Column:
    """Every way to write "featuring" becomes `` feat. ``."""
    return one_space(F.regexp_replace(F.regexp_replace(c, FEAT_WORD, "feat."), FEAT_SPACED, " feat. "))


def sort_names(c: Column) -> Column:
    """Names between commas, in the order of their lower-case forms; ties keep their order."""
    names = F.filter(F.transform(F.split(c, ","), utrim), lambda x: x != "")
    keyed = F.transform(names, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("i"), x.alias("name")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["name"]), ", ")


def sort_artists(c: Column, alphabetical: bool = True) -> Column:
    """Both sides of the first ``feat.`` sorted for themselves; acts joined by ``&`` stay whole."""
    a = std_feat(c)
    return F.array_join(F.transform(F.split(a, FEAT_SPLIT, 2), sort_names), " feat. ") if alphabetical else a


def dedupe_parens(c: Column) -> Column:
    """A group in parentheses goes if an earlier one has the same letters and digits, if any."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\([^)]*\)|[^(]+|\()"), F.lit(1))
    keyed = F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.when(p.rlike(r"(?s)^\([^)]*\)$"), F.regexp_replace(F.lower(p), "[^a-z0-9]", "")).otherwise("").alias("key")))
    empty = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("seen"))

    def fold(acc: Column, p: Column) -> Column:
        again = (p["key"] != "") & F.array_contains(acc["seen"], p["key"])
        return F.struct(F.when(again, acc["out"]).otherwise(F.concat(acc["out"], p["piece"])).alias("out"), F.when(p["key"] == "", acc["seen"]).otherwise(F.array_append(acc["seen"], p["key"])).alias("seen"))

    whole = one_space(F.aggregate(keyed, empty, fold, lambda acc: acc["out"]))
    return F.when(F.contains(c, F.lit("(")), whole).otherwise(one_space(c))


def sanitize(c: Column) -> Column:
    """Fit for a file name."""
    return F.regexp_replace(strip_junk(F.regexp_replace(c, FORBIDDEN, "")), r"[. ]+\z", "")


def is_slug(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9]+(-[a-z0-9.]+)+\z")


def titlecase_slug(c: Column) -> Column:
    return F.regexp_replace(F.initcap(one_space(F.translate(c, "-", " "))), r"\bDj\b", "DJ")


def collapse_doubled_mix(c: Column) -> Column:
    return F.regexp_replace(c, DOUBLED_MIX, "$1")


def splitext(c: Column) -> tuple[Column, Column]:
    """Root and extension; leading dots begin no extension."""
    pattern = r"(?s)^(\.*.*?)(\.[^.]*)?\z"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def parse_name(c: Column) -> tuple[Column, Column]:
    """Artist and title of ``Artist - Title.ext``; without a separator all of it is the title."""
    parts = F.split(splitext(c)[0], " - ", 2)
    two = F.size(parts) == 2
    return utrim(F.when(two, F.get(parts, F.lit(0))).otherwise("")), utrim(F.element_at(parts, -1))


def strip_track_number(c: Column) -> Column:
    return F.regexp_replace(c, TRACK_NUMBER, "")


def segments(c: Column) -> Column:
    """Parts between separators once label codes are gone, without dashes at their ends."""
    parts = F.split(F.regexp_replace(c, LABEL_CODE, " - "), " - ")
    return F.filter(F.transform(parts, lambda s: utrim(F.regexp_replace(s, r"(?U)^-+\s*|\s*-+$", ""))), lambda s: s != "")


def base_of_name(c: Column) -> Column:
    """What parse_filename looks at: no extension, junk, track number or doubled mix."""
    return collapse_doubled_mix(strip_track_number(strip_junk(F.regexp_replace(c, r"\.[^.]+\z", ""))))


def parse_base(base: Column, parts: Column | None = None) -> tuple[Column, Column]:
    """Artist ('' where there is none) and title of a name's base; ``parts`` are its segments."""
    parts = segments(base) if parts is None else parts
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    compilation = (F.size(parts) >= 3) & last.rlike(r"(?U)^\d{1,2}\s+\S")
    sides = F.split(base, " - ", 2)
    artist = F.when(is_slug(base), "").when(compilation, F.get(parts, F.lit(0))).when(F.contains(base, F.lit(" - ")), utrim(F.get(sides, F.lit(0)))).otherwise("")
    title = F.when(is_slug(base), titlecase_slug(base)).when(compilation, F.regexp_replace(last, r"(?U)^\d{1,2}\s+", "")).otherwise(utrim(F.element_at(sides, -1)))
    return artist, title


def parse_filename(c: Column) -> tuple[Column, Column]:
    return parse_base(base_of_name(c))


def add_missing_mix(title: Column, name_title: Column) -> Column:
    """A title without a mix in parentheses gets those of the file name's title."""
    found = F.filter(F.regexp_extract_all(name_title, F.lit(f"({PAREN})"), F.lit(1)), lambda p: p.rlike("(?i)" + _MIX))
    longer = let(F.array_join(found, " "), lambda more: F.when(more == "", title).otherwise(utrim(F.concat_ws(" ", title, more))))
    return F.when((name_title == "") | title.rlike(rf"(?i)\([^)]*{_MIX}[^)]*\)"), title).otherwise(longer)


def normalized(c: Column, form: str) -> Column:
    """NFKD or NFC, by the library that Spark brings along."""
    method, compat = {"NFKD": ("decompose", True), "NFC": ("compose", False)}[form]
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(compat))


def norm_part(c: Column) -> Column:
    """Letters a-z and digits of a text without accents, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(normalized(c, "NFKD"), r"\p{Mn}", "")), "[^a-z0-9]+", " "))


def norm_key(artist: Column, title: Column) -> Column:
    return F.concat(norm_part(artist), F.lit("|"), norm_part(title))


def path_key(c: Column) -> Column:
    """One form of a path: composed, lower-case, backslashes, no ``.`` and ``..``, never above a drive."""

    def fold(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 1) | ((F.size(acc) == 1) & ~F.coalesce(F.get(acc, F.lit(0)), F.lit("")).endswith(":"))
        return F.when(part.isin("", "."), acc).when(part == "..", F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.array_append(acc, part))

    return F.array_join(F.aggregate(F.split(F.lower(normalized(c, "NFC")), r"[/\\]"), F.array().cast("array<string>"), fold), "\\")


def split_path(c: Column) -> tuple[Column, Column]:
    """Folder and name at the last slash of either kind."""
    return F.regexp_extract(c, r"(?s)^(.*)[/\\][^/\\]*\z", 1), F.regexp_extract(c, r"([^/\\]*)\z", 1)


def ext_of(c: Column) -> Column:
    return F.lower(splitext(split_path(c)[1])[1])


def has_extension(c: Column, extensions: tuple[str, ...]) -> Column:
    """Whether a name ends so, in any case; a name that is nothing else does too."""
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(F.lower(c), F.lit(e))
    return out


def quality_rank(ext: Column) -> Column:
    ranked = F.create_map(*[F.lit(x) for pair in QUALITY.items() for x in pair])
    return F.coalesce(F.try_element_at(ranked, ext), F.lit(0))


def first_nonempty(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b)


def human_size(c: Column) -> Column:
    """Megabytes with one decimal above 1 MiB, else whole kilobytes, rounded up."""
    mega, kilo = c / F.lit(1048576.0), F.ceil(c / F.lit(1024.0))
    return F.when(c > 1048576, F.concat(F.format_string("%.1f", mega), F.lit(" MB"))).otherwise(F.concat(kilo.cast("string"), F.lit(" KB")))
