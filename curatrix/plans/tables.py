"""The test tables dressed as files, names and collection entries, in Spark and in SQL.

``documents`` are files: doc_id is their order, n_chars their size, source gives the extension, and the
title is a short name of its own that follows the size; contents are whole texts.
``part`` gives names to plan; ``conversations`` and ``labels`` are children of entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as t

EXTENSIONS = (".wav", ".mp3", ".flac", ".m4a", ".aiff", ".ogg", ".aifc", ".aif")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- files -----------------------------------------------------------------------------------------

_LIST = ", ".join(f"'{e}'" for e in EXTENSIONS)
def key_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


KEY_SQL = key_sql("text")
FILES_SQL = f"""
files AS (SELECT doc_id AS ord, lang, text, n_chars AS size, sha256(text) AS hash, [{_LIST}][1 + CAST(substr(source, 4) AS INTEGER) % 8] AS ext,
                 lang AS artist, CASE WHEN n_chars % 89 = 5 THEN '' ELSE 'Träck,  Nº ' || n_chars % 997 END AS title
          FROM documents),
ranked AS (SELECT *, '/' || lang || '/' || lang || ' - ' || ord || ext AS path, {key_sql('artist')} || '|' || {key_sql('''replace(title, 'º', 'o')''')} AS key,
                  CASE WHEN ext IN ('.wav', '.aiff', '.aif', '.aifc', '.flac') THEN 3 WHEN ext IN ('.m4a', '.ogg', '.mp3') THEN 1 ELSE 0 END AS rank FROM files)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, path, artist, title, ext, dur, size, key, content."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), 1 + F.substring("source", 4, 10).cast("int") % 8)
    title = F.when(F.col("n_chars") % 89 == 5, "").otherwise(F.concat(F.lit("Träck,  Nº "), (F.col("n_chars") % 997).cast("string")))
    rows = docs.select(F.col("doc_id").alias("ord"), "lang", ext.alias("ext"), title.alias("title"), F.col("n_chars").alias("size"), F.col("text").cast("binary").alias("content"))
    path = F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("lang"), F.lit(" - "), F.col("ord").cast("string"), F.col("ext"))
    return rows.select("ord", path.alias("path"), F.col("lang").alias("artist"), "title", "ext", F.lit(None).cast("double").alias("dur"), "size", t.norm_key(F.col("lang"), F.col("title")).alias("key"), "content")


# -- names -----------------------------------------------------------------------------------------

#: What follows the word CASE in both languages; w1 and w2 are the two words of a part's name.
_SHAPES = """CASE p_partkey % 10
 WHEN 0 THEN '01 ' || p_brand || ' - ' || p_name || '.mp3'
 WHEN 1 THEN w2 || ', ' || w1 || ' - ' || p_type || ' (Original Mix).wav'
 WHEN 2 THEN w1 || ' ft ' || w2 || ', ' || p_brand || ' - ' || p_type || '.flac'
 WHEN 3 THEN w1 || '-' || w2 || '-original-mix-original-mix.mp3'
 WHEN 4 THEN p_brand || ' - Best Of - 12 ' || p_name || '.ogg'
 WHEN 5 THEN p_brand || ' - ABC123 - ' || p_name || ' (Remix) (remix).mp3'
 WHEN 6 THEN p_name || '.wav'
 WHEN 7 THEN '  ' || p_brand || '   -  ' || p_name || '  .MP3'
 WHEN 8 THEN w1 || '_' || w2 || '_-_' || p_type || '.mp3'
 ELSE p_brand || ' - ' || p_type || ': "' || p_name || '"?.aiff' END"""
NAMES_SQL = f"words AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part), names AS (SELECT p_partkey, p_name, p_brand, p_type, w1, w2, {_SHAPES} AS name FROM words)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_name, p_brand, p_type, w1, w2, name."""
    words = table(spark, sf_dir, "part").withColumn("w1", F.split_part("p_name", F.lit(" "), F.lit(1))).withColumn("w2", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return words.select("p_partkey", "p_name", "p_brand", "p_type", "w1", "w2", F.expr(_SHAPES).alias("name"))


# -- collection ------------------------------------------------------------------------------------

COLLECTION_SQL = f"""
{FILES_SQL},
content AS (SELECT CAST(r.ord AS VARCHAR) AS id, r.ord,
                   CASE WHEN r.ord % 50 = 7 THEN 'spotify:track:' || r.ord WHEN r.ord % 50 = 8 THEN ''
                        WHEN r.ord % 10 = 3 THEN upper('C:\\Music\\' || r.lang || '\\' || r.title || '.wav')
                        ELSE 'C:/Music/' || r.lang || '/' || r.artist || ' - ' || r.title || r.ext END AS path,
                   r.title, CAST(r.size % 7 AS VARCHAR) AS created, CAST(r.ord % 5 AS INTEGER) AS plays,
                   coalesce(l.quality, 0) AS rating, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS comment
            FROM ranked r LEFT JOIN labels l ON l.doc_id = r.ord),
cues AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS content_id FROM conversations WHERE turn % 2 = 0),
playlists AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, role AS playlist_id, CAST(conv_id AS VARCHAR) AS content_id FROM conversations WHERE turn % 2 = 1)
"""
PATH_KEY_SQL = "array_to_string(list_filter(regexp_split_to_array(lower(nfc_normalize(path)), '[/\\\\]'), lambda p: p NOT IN ('', '.')), '\\')"
#: A path's name, and the pattern of its root and extension, which leading dots don't begin.
NAME_SQL, SPLIT_SQL = "regexp_extract(path, '([^/\\\\]*)$', 1)", "^(\\.*.*?)(\\.[^.]*)?$"
ENTRIES_SQL = f"""
{COLLECTION_SQL},
nc AS (SELECT content_id, count(*) AS n_cues FROM cues GROUP BY content_id),
np AS (SELECT content_id, count(*) AS n_lists FROM playlists GROUP BY content_id),
loaded AS (SELECT c.*, coalesce(n_cues, 0) AS n_cues, coalesce(n_lists, 0) AS n_lists, lower(regexp_extract({NAME_SQL}, '{SPLIT_SQL}', 2)) AS file_ext
           FROM content c LEFT JOIN nc ON nc.content_id = c.id LEFT JOIN np ON np.content_id = c.id
           WHERE path <> '' AND path NOT LIKE 'spotify:%'),
entries AS (SELECT *, 3 * n_cues + 2 * n_lists + plays + CAST(rating <> 0 AS INTEGER) + CAST(comment <> '' AS INTEGER) AS info,
                   CASE WHEN file_ext IN ('.wav', '.aiff', '.aif', '.aifc', '.flac') THEN 3 WHEN file_ext IN ('.m4a', '.ogg', '.mp3') THEN 1 ELSE 0 END AS quality_rank,
                   {PATH_KEY_SQL} AS path_key, regexp_extract({NAME_SQL}, '{SPLIT_SQL}', 1) AS stem FROM loaded),
keyed AS (SELECT *, CASE WHEN contains(stem, ' - ') THEN trim(split_part(stem, ' - ', 1)) ELSE '' END AS song_artist,
                 CASE WHEN contains(stem, ' - ') THEN trim(substr(stem, position(' - ' IN stem) + 3)) ELSE trim(stem) END AS song_title FROM entries),
songs AS (SELECT *, {key_sql('song_artist')} || '|' || {key_sql("replace(song_title, 'º', 'o')")} AS song_key FROM keyed),
g1 AS (SELECT *, count(*) OVER (PARTITION BY path_key) AS n FROM songs),
file_rows AS (SELECT *, 1 AS pass, min(id) OVER (PARTITION BY path_key) AS first, row_number() OVER (PARTITION BY path_key ORDER BY quality_rank DESC, info DESC, created, id) AS rn,
                     first_value(id) OVER (PARTITION BY path_key ORDER BY quality_rank DESC, info DESC, created, id) AS keeper FROM g1 WHERE n > 1),
g2 AS (SELECT *, count(*) OVER (PARTITION BY song_key) AS m FROM g1 WHERE n = 1 AND song_title <> ''),
song_rows AS (SELECT * EXCLUDE (m), 2 AS pass, min(id) OVER (PARTITION BY song_key) AS first, row_number() OVER (PARTITION BY song_key ORDER BY quality_rank DESC, info DESC, created, id) AS rn,
                     first_value(id) OVER (PARTITION BY song_key ORDER BY quality_rank DESC, info DESC, created, id) AS keeper FROM g2 WHERE m > 1),
grouped AS (SELECT *, dense_rank() OVER (ORDER BY pass, first) AS grp FROM (SELECT * FROM file_rows UNION ALL SELECT * FROM song_rows))
"""


def collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Content, cues and playlists."""
    rows = files(spark, sf_dir).drop("content").join(table(spark, sf_dir, "labels"), F.col("ord") == F.col("doc_id"), "left")
    c = F.col
    odd = F.upper(F.concat(F.lit("C:\\Music\\"), c("artist"), F.lit("\\"), c("title"), F.lit(".wav")))
    path = F.when(c("ord") % 50 == 7, F.concat(F.lit("spotify:track:"), c("ord").cast("string"))).when(c("ord") % 50 == 8, "").when(c("ord") % 10 == 3, odd)
    path = path.otherwise(F.concat(F.lit("C:/Music/"), c("artist"), F.lit("/"), c("artist"), F.lit(" - "), c("title"), c("ext")))
    content = rows.select(c("ord").cast("string").alias("id"), path.alias("path"), "title", (c("size") % 7).cast("string").alias("created"), (c("ord") % 5).cast("int").alias("plays"), F.coalesce("quality", F.lit(0)).alias("rating"), F.when(c("toxic") == 1, "toxic").otherwise("").alias("comment"))
    talks = table(spark, sf_dir, "conversations").select((c("conv_id") * 1000 + c("turn")).cast("string").alias("id"), c("conv_id").cast("string").alias("content_id"), "turn", c("role").alias("playlist_id"))
    return content, talks.where("turn % 2 = 0").select("id", "content_id"), talks.where("turn % 2 = 1").select("id", "playlist_id", "content_id")
