from pyspark.sql import functions as F

from curatrix.functions import native
from curatrix.functions import text as t


def values(spark, texts, function):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    made = function(F.col("x"))
    columns = made if isinstance(made, tuple) else (made,)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_strip_junk_removes_controls_and_evens_spaces(spark):
    assert values(spark, ["a\u00a0 b\u200bc\u0007\u3000 d ", "", "\t x \t"], t.strip_junk) == [("a bc d",), ("",), ("x",)]


def test_feat(spark):
    texts = ["A ft B", "A FEATURING B", "A (feat. B)", "A feats.B", "craft", "A   ft.   B"]
    assert [r[0] for r in values(spark, texts, t.std_feat)] == ["A feat. B", "A feat. B", "A ( feat. B)", "A feat. B", "craft", "A feat. B"]


def test_sort_artists(spark):
    texts = ["quill, Moss & Fern, Ivy", "Wren, Lark feat. Teal, Coot", "k,,K, j", ""]
    assert [r[0] for r in values(spark, texts, t.sort_artists)] == ["Ivy, Moss & Fern, quill", "Lark, Wren feat. Coot, Teal", "j, k, K", ""]
    assert values(spark, ["b, a"], lambda x: t.sort_artists(x, False)) == [("b, a",)]


def test_dedupe_parens(spark):
    texts = ["T (Mix) (mix!)", "T (a) (b)", "T () ()", "T (a", "T (a) x (A) y", "no groups  here"]
    assert [r[0] for r in values(spark, texts, t.dedupe_parens)] == ["T (Mix)", "T (a) (b)", "T () ()", "T (a", "T (a) x y", "no groups here"]


def test_sanitize(spark):
    assert [r[0] for r in values(spark, ['a/b:c*"d"?<>|\\ ...', "x. . "], t.sanitize)] == ["abcd", "x"]


def test_splitext_and_parse_name(spark):
    cases = ["a.b.c", ".hidden", "...", "a.", "..a.b", "plain", ""]
    got = values(spark, cases, t.splitext)
    assert got == [native.splitext(c) for c in cases] == [("a.b", ".c"), (".hidden", ""), ("...", ""), ("a", "."), ("..a", ".b"), ("plain", ""), ("", "")]
    cases = ["A - B - C.mp3", "only.wav", " A  -  B .x", ""]
    assert values(spark, cases, t.parse_name) == [native.parse_name(c) for c in cases]


def test_parse_filename(spark):
    cases = {
        "02 Wren - Dusk.ogg": ("Wren", "Dusk"), "31_Wren - Dusk.ogg": ("Wren", "Dusk"), "7 - Wren - Dusk.aif": ("Wren", "Dusk"), "88 Keys - Dusk.flac": ("88 Keys", "Dusk"), "9.81 - Dusk.flac": ("9.81", "Dusk"),
        "Wren - Sampler - 14 Dusk.ogg": ("Wren", "Dusk"), "Wren - QLM204 - Dusk.ogg": ("Wren", "QLM204 - Dusk"), "dj-long-dusk.ogg": ("", "DJ Long Dusk"), "w-d-extended-mix-Extended-Mix.ogg": ("", "W D Extended Mix"),
        "dusk alone.ogg": ("", "dusk alone"), "Wren - Dusk - Dawn.ogg": ("Wren", "Dusk - Dawn"),
    }
    # A doubled mix collapses whatever its case, and what is left may be a slug.
    assert dict(zip(cases, values(spark, cases, t.parse_filename), strict=True)) == cases


def test_add_missing_mix(spark):
    df = spark.createDataFrame([(1, "T", "T (X Remix) (Live) (VIP)"), (2, "T (Dub)", "T (X Remix)"), (3, "T", ""), (4, "", "T (Edit)")], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(t.add_missing_mix(F.col("a"), F.col("b"))).collect()]
    assert got == ["T (X Remix) (VIP)", "T (Dub)", "T", "(Edit)"]


def test_norm_key_and_path_key(spark):
    assert values(spark, ["Àrtist  Söng! ﬁ ①"], t.norm_part) == [("artist song fi 1",)]
    paths = ["C:/Music/A.mp3", "c:\\MUSIC\\.\\x\\..\\a.mp3", "C:/../a", "a/../../b", "//x//y/"]
    assert [r[0] for r in values(spark, paths, t.path_key)] == ["c:\\music\\a.mp3", "c:\\music\\a.mp3", "c:\\a", "b", "x\\y"]


def test_human_size(spark):
    df = spark.createDataFrame([(1048577,), (1048576,), (1,)], "x long")
    assert [r[0] for r in df.select(t.human_size(F.col("x"))).collect()] == ["1.0 MB", "1024 KB", "1 KB"]
