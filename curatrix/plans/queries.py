"""One query for each operator, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.lineage import materialize, shared_path
from curatrix.operators import codec, collection, dedup, health, naming
from curatrix.plans import tables as src
from curatrix.plans.tables import ENTRIES_SQL, FILES_SQL, KEY_SQL, NAMES_SQL, PATH_KEY_SQL, table
from curatrix.sources import mapping, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# -- pieces of SQL ---------------------------------------------------------------------------------


def _every(x: str, pattern: str, by: str) -> str:
    pattern, by = pattern.replace("'", "''"), by.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _even(x: str) -> str:
    return f"trim({_every(x, '[[:space:]]+', ' ')})"


def _junk(x: str) -> str:
    return _even(_every(x, r"\p{C}", ""))


def _feat(x: str) -> str:
    return _even(_every(_every(x, r"(?i)\b(?:feat(?:uring|s)?|ft)\b\.?", "feat."), r"(?i)\s*\bfeat\.\s*", " feat. "))


def _sorted(x: str) -> str:
    names = f"list_filter(list_transform(string_split({x}, ','), lambda p: trim(p)), lambda p: p <> '')"
    return f"array_to_string(list_transform(list_sort(list_transform({names}, lambda p: {{'k': lower(p), 'v': p}})), lambda s: s.v), ', ')"


def _artists(x: str) -> str:
    f = _feat(x)
    return f"CASE WHEN contains({f}, ' feat. ') THEN {_sorted(f'''split_part({f}, ' feat. ', 1)''')} || ' feat. ' || {_sorted(f'''substr({f}, position(' feat. ' IN {f}) + 7)''')} ELSE {_sorted(f)} END"


def _parens(x: str) -> str:
    pieces = f"regexp_extract_all({x}, '(\\([^)]*\\)|[^(]+|\\()', 1)"
    key = lambda p: f"CASE WHEN regexp_full_match({p}, '\\([^)]*\\)') THEN regexp_replace(lower({p}), '[^a-z0-9]', '', 'g') ELSE '' END"
    keep = f"list_filter({pieces}, lambda p, i: {key('p')} = '' OR NOT list_contains(list_transform({pieces}[1:i - 1], lambda q: {key('q')}), {key('p')}))"
    return _even(f"array_to_string({keep}, '')")


def _safe(x: str) -> str:
    return f"regexp_replace({_junk(_every(x, t.FORBIDDEN, ''))}, '[. ]+$', '')"


_ROOT, _EXT = "regexp_extract({0}, '^(\\.*.*?)(\\.[^.]*)?$', 1)", "regexp_extract({0}, '^(\\.*.*?)(\\.[^.]*)?$', 2)"
_DOUBLED = [r"(?i)(-original-mix)-original-mix", r"(?i)(-extended-mix)-extended-mix", r"(?i)(-radio-mix)-radio-mix"]


def _doubled(x: str) -> str:
    for pattern in _DOUBLED:
        x = _every(x, pattern, r"\1")
    return x


_NUMBER = r"^(?:0\d[\s_.\-]+|\d{1,2}(?:\.\s+|\s*-\s+|_+))"
_SLUG = "regexp_full_match(base, '[a-z0-9]+(-[a-z0-9.]+)+')"
_TITLECASE = "regexp_replace(array_to_string(list_transform(string_split(replace(base, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), '\\bDj\\b', 'DJ', 'g')"
PARSED_SQL = f"""
{NAMES_SQL},
based AS (SELECT *, {_doubled(f"regexp_replace({_junk('''regexp_replace(name, '[.][^.]+$', '')''')}, '{_NUMBER}', '')")} AS base FROM names),
cut AS (SELECT *, list_filter(list_transform(string_split({_every('base', r'\s*-\s*[A-Z]{2,6}\d{2,4}\s*-\s*', ' - ')}, ' - '), lambda s: trim({_every('s', r'^-+\s*|\s*-+$', '')})), lambda s: s <> '') AS segs FROM based),
parsed AS (SELECT *, len(segs) >= 3 AND regexp_matches(coalesce(segs[-1], ''), '^\\d{{1,2}}\\s+\\S') AS compilation,
  CASE WHEN {_SLUG} THEN '' WHEN len(segs) >= 3 AND regexp_matches(coalesce(segs[-1], ''), '^\\d{{1,2}}\\s+\\S') THEN segs[1]
       WHEN contains(base, ' - ') THEN trim(split_part(base, ' - ', 1)) ELSE '' END AS artist,
  CASE WHEN {_SLUG} THEN {_TITLECASE} WHEN len(segs) >= 3 AND regexp_matches(coalesce(segs[-1], ''), '^\\d{{1,2}}\\s+\\S') THEN regexp_replace(segs[-1], '^\\d{{1,2}}\\s+', '')
       WHEN contains(base, ' - ') THEN trim(substr(base, position(' - ' IN base) + 3)) ELSE trim(base) END AS title FROM cut)
"""
PLANNED_SQL = f"""
{PARSED_SQL},
built AS (SELECT name AS old, CASE WHEN artist <> '' AND title <> '' THEN {_safe(_parens(f"{_artists('artist')} || ' - ' || {_feat('title')}"))} || lower({_EXT.format('name')}) ELSE '' END AS new,
                 CASE WHEN artist <> '' AND title <> '' THEN 'filename' ELSE 'manual' END AS origin FROM parsed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lower(new) ORDER BY old) AS n FROM built),
plan AS (SELECT old, CASE WHEN new <> '' AND n > 1 THEN {_ROOT.format('new')} || ' (' || n || ')' || {_EXT.format('new')} ELSE new END AS new, origin FROM numbered)
"""
EXACT_SQL = f"""
{FILES_SQL},
sized AS (SELECT *, min(ord) OVER (PARTITION BY size) AS g1, min(ord) OVER (PARTITION BY size, hash) AS g2, count(*) OVER (PARTITION BY size, hash) AS n,
                 row_number() OVER (PARTITION BY size, hash ORDER BY rank DESC, size DESC, ord) AS rn FROM ranked),
exact AS (SELECT * FROM sized WHERE n > 1)
"""
BOTH_SQL = f"""
{EXACT_SQL},
keyed AS (SELECT *, min(ord) OVER (PARTITION BY key) AS k1, count(*) OVER (PARTITION BY key) AS m, row_number() OVER (PARTITION BY key ORDER BY rank DESC, size DESC, ord) AS kn FROM ranked WHERE title <> ''),
fresh AS (SELECT * FROM keyed WHERE m > 1 AND (kn = 1 OR ord NOT IN (SELECT ord FROM exact WHERE rn > 1))),
songs AS (SELECT * FROM fresh WHERE key IN (SELECT key FROM fresh WHERE kn > 1)),
unioned AS (SELECT 1 AS pass, g1, g2, rn, ord, path, artist, title, ext, size FROM exact UNION ALL SELECT 2, k1, k1, kn, ord, path, artist, title, ext, size FROM songs),
dups AS (SELECT *, dense_rank() OVER (ORDER BY pass, g1, g2) AS grp FROM unioned)
"""


# -- names -----------------------------------------------------------------------------------------


@query(f"WITH e AS (SELECT page_id, url || ['.MP3', '.aifc', '.Wav', '.txt', '.flac', ''][1 + page_id % 6] AS path FROM pages) SELECT page_id, regexp_matches(lower(path), '[.](mp3|wav|aiff|aif|flac|m4a|ogg)$') AS nameable, regexp_matches(lower(path), '[.](mp3|wav|aiff|aif|flac|m4a|ogg|aifc)$') AS scannable, regexp_matches(lower(path), '[.](mp3|wav|aiff|aif|aifc)$') AS taggable FROM e")
def q01_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, (".MP3", ".aifc", ".Wav", ".txt", ".flac", "")))
    path = F.concat("url", F.element_at(ends, (1 + F.col("page_id") % 6).cast("int")))
    kinds = {"nameable": t.NAME_EXTENSIONS, "scannable": t.FILE_EXTENSIONS, "taggable": t.TAG_EXTENSIONS}
    return table(spark, sf_dir, "pages").select("page_id", *[t.has_extension(path, e).alias(n) for n, e in kinds.items()])


@query(f"SELECT doc_id, {_junk('text')} AS text FROM documents")
def q02_strip_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.strip_junk(F.col("text")).alias("text"))


_FEATS = "p_name || [' ft ', ' feat ', ' Featuring ', ' FT. ', ' feats  '][1 + p_partkey % 5] || p_brand || '  (ft. X)'"


@query(f"SELECT p_partkey, {_feat(_FEATS)} AS title FROM part")
def q03_std_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, (" ft ", " feat ", " Featuring ", " FT. ", " feats  "))), (1 + F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.std_feat(F.concat("p_name", word, "p_brand", F.lit("  (ft. X)"))).alias("title"))


_ACTS = "w2 || ', ' || p_brand || ' & Co,, ' || w1 || CASE WHEN p_partkey % 2 = 0 THEN ' ft. ' || p_type || ', ' || w2 ELSE '' END"


@query(f"WITH {NAMES_SQL} SELECT p_partkey, {_artists(_ACTS)} AS artists FROM names")
def q04_sort_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.names(spark, sf_dir).select("p_partkey", t.sort_artists(F.expr(_ACTS)).alias("artists"))


_GROUPS = "p_name || ' (' || p_type || ') (x) (' || lower(p_type) || '!) (' || w1 || ') () () (X) (' || w2"


@query(f"WITH {NAMES_SQL} SELECT p_partkey, {_parens(_GROUPS)} AS title FROM names")
def q05_dedupe_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.names(spark, sf_dir).select("p_partkey", t.dedupe_parens(F.expr(_GROUPS)).alias("title"))


@query(f"SELECT doc_id, {_safe('''text || ': \"<?*>| .. ' ''')} AS name FROM documents")
def q06_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.sanitize(F.concat("text", F.lit(': "<?*>| .. '))).alias("name"))


@query(f"WITH {NAMES_SQL}, s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'dj-' || w1 || '-' || w2 ELSE w1 || '-' || p_type END AS base FROM names) SELECT p_partkey, {_SLUG} AS slug, {_TITLECASE} AS title FROM s")
def q07_slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'dj-' || w1 || '-' || w2 ELSE w1 || '-' || p_type END")
    return src.names(spark, sf_dir).select("p_partkey", t.is_slug(base).alias("slug"), t.titlecase_slug(base).alias("title"))


_MIXES = "w1 || ['-original-mix-Original-Mix', '-radio-mix-radio-mix-radio-mix', '-extended-mix-radio-mix', '-mix-mix'][1 + p_partkey % 4] || '-' || w2"


@query(f"WITH {NAMES_SQL} SELECT p_partkey, {_doubled(_MIXES)} AS name FROM names")
def q08_doubled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixes = F.array(*map(F.lit, ("-original-mix-Original-Mix", "-radio-mix-radio-mix-radio-mix", "-extended-mix-radio-mix", "-mix-mix")))
    name = F.concat("w1", F.element_at(mixes, (1 + F.col("p_partkey") % 4).cast("int")), F.lit("-"), "w2")
    return src.names(spark, sf_dir).select("p_partkey", t.collapse_doubled_mix(name).alias("name"))


@query(f"WITH {PARSED_SQL} SELECT p_partkey, artist, title FROM parsed")
def q09_parse_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    artist, title = t.parse_filename(F.col("name"))
    return src.names(spark, sf_dir).select("p_partkey", artist.alias("artist"), title.alias("title"))


@query(f"WITH {NAMES_SQL}, r AS (SELECT p_partkey, {_ROOT.format('name')} AS root, {_EXT.format('name')} AS ext FROM names) SELECT p_partkey, root, ext, CASE WHEN contains(root, ' - ') THEN trim(split_part(root, ' - ', 1)) ELSE '' END AS artist, CASE WHEN contains(root, ' - ') THEN trim(substr(root, position(' - ' IN root) + 3)) ELSE trim(root) END AS title FROM r")
def q10_parse_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    (root, ext), (artist, title) = t.splitext(name), t.parse_name(name)
    return src.names(spark, sf_dir).select("p_partkey", root.alias("root"), ext.alias("ext"), artist.alias("artist"), title.alias("title"))


_TITLE, _NAME_TITLE = "p_type || CASE WHEN p_partkey % 4 = 0 THEN ' (Dub)' ELSE '' END", "p_type || ' (' || p_name || ' Remix) (' || w1 || ') (VIP)'"
_MIX = "(?i)(?:" + "|".join(t.MIX_WORDS) + ")"


@query(f"WITH {NAMES_SQL}, x AS (SELECT p_partkey, {_TITLE} AS title, list_filter(regexp_extract_all({_NAME_TITLE}, '(\\([^)]*\\))', 1), lambda p: regexp_matches(p, '{_MIX}')) AS found FROM names) SELECT p_partkey, CASE WHEN regexp_matches(title, '(?i)\\([^)]*{_MIX}[^)]*\\)') THEN title ELSE title || ' ' || array_to_string(found, ' ') END AS title FROM x")
def q11_add_missing_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.names(spark, sf_dir).select("p_partkey", t.add_missing_mix(F.expr(_TITLE), F.expr(_NAME_TITLE)).alias("title"))


@query(f"SELECT doc_id, lang || '|' || {KEY_SQL} AS key FROM documents")
def q12_norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.norm_key(F.col("lang"), F.col("text")).alias("key"))


# What goes up is left out of the SQL's path: a folder and its "..", or all but the part that ends with a colon.
@query(f"WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN upper(replace(url, '/', '\\')) || '/./' WHEN 2 THEN url || '/T\u00f6p' ELSE split_part(url, '/', 1) || '/Top' END AS path FROM pages) SELECT page_id, {PATH_KEY_SQL} AS path_key FROM p")
def q13_path_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, kind = F.col("url"), F.col("page_id") % 4
    odd = F.concat(F.upper(F.translate("url", "/", "\\")), F.lit("/./"))
    path = F.when(kind == 0, url).when(kind == 1, odd).when(kind == 2, F.concat(url, F.lit("/a/./B/../..\\To\u0308p"))).otherwise(F.concat(url, F.lit("/.." * 40 + "/Top")))
    return table(spark, sf_dir, "pages").select("page_id", t.path_key(path).alias("path_key"))


@query("WITH p AS (SELECT page_id, regexp_extract(url, '^(.*)[/\\\\][^/\\\\]*$', 1) AS folder, regexp_extract(url, '([^/\\\\]*)$', 1) AS name FROM pages) SELECT *, lower(regexp_extract(name, '^(\\.*.*?)(\\.[^.]*)?$', 2)) AS ext FROM p")
def q14_split_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, name = t.split_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", folder.alias("folder"), name.alias("name"), t.ext_of(F.col("url")).alias("ext"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.plan_names(src.names(spark, sf_dir))


@query(f"WITH {PLANNED_SQL} SELECT old, new, origin FROM plan")
def q15_build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


#: Tags that follow from a name's length: both, one of them, or none.
_TAG_ARTIST = "CASE WHEN length(name) % 5 < 3 THEN 'T\u00e4g_' || name ELSE '' END"
_TAG_TITLE = "CASE length(name) % 5 WHEN 0 THEN 'Tune ft. ' || name WHEN 1 THEN 'Tune (Dub) ' || length(name) WHEN 3 THEN 'Only' ELSE '' END"
_FOUND = f"list_filter(regexp_extract_all(title, '(\\([^)]*\\))', 1), lambda p: regexp_matches(p, '{_MIX}'))"
TAGGED_SQL = f"""
{PARSED_SQL},
tagged AS (SELECT *, {_junk(f"replace({_TAG_ARTIST}, '_', ' ')")} AS ta, {_junk(f"replace({_TAG_TITLE}, '_', ' ')")} AS tt FROM parsed),
mixed AS (SELECT *, CASE WHEN title = '' OR len({_FOUND}) = 0 OR regexp_matches(tt, '(?i)\\([^)]*{_MIX}[^)]*\\)') THEN tt ELSE tt || ' ' || array_to_string({_FOUND}, ' ') END AS tm FROM tagged),
chosen AS (SELECT name, CASE WHEN ta <> '' THEN ta ELSE artist END AS a, CASE WHEN ta <> '' AND tt <> '' THEN tm WHEN tt <> '' THEN tt ELSE title END AS b,
                  CASE WHEN ta <> '' AND tt <> '' THEN 'tags' WHEN ta <> '' OR tt <> '' THEN 'mixed' ELSE 'filename' END AS origin FROM mixed),
built AS (SELECT name AS old, CASE WHEN a <> '' AND b <> '' THEN {_safe(_parens(f"{_artists('a')} || ' - ' || {_feat('b')}"))} || lower({_EXT.format('name')}) ELSE '' END AS new, CASE WHEN a <> '' AND b <> '' THEN origin ELSE 'manual' END AS origin FROM chosen),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lower(new) ORDER BY old) AS n FROM built),
plan AS (SELECT old, CASE WHEN new <> '' AND n > 1 THEN {_ROOT.format('new')} || ' (' || n || ')' || {_EXT.format('new')} ELSE new END AS new, origin FROM numbered)
"""


@query(f"WITH {TAGGED_SQL} SELECT old, new, origin FROM plan")
def q15b_plan_with_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = src.names(spark, sf_dir)
    tags = names.select("name", F.expr(_TAG_ARTIST).alias("artist"), F.expr(_TAG_TITLE).alias("title")).where("artist <> '' OR title <> ''").distinct()
    return naming.plan_names(names, tags)


@query(f"WITH {PLANNED_SQL} SELECT trim(old) AS old, new FROM plan WHERE new <> '' AND new <> old")
def q15c_plan_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_path(spark, 'plan')}.csv"
    sinks.write_single(sinks.plan_rows(_plan(spark, sf_dir)), path)
    return mapping.load_mapping(spark, path).select("old", "new")


@query(f"WITH {PLANNED_SQL} SELECT trim(old) AS old, new FROM plan WHERE new <> '' AND new <> old AND length(old) % 2 = 0")
def q15d_rollback_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = materialize(_plan(spark, sf_dir), "plan")
    done = plan.where(F.length("old") % 2 == 0).select("old").distinct()
    path = f"{shared_path(spark, 'rollback')}.csv"
    sinks.write_single(sinks.rollback_rows(naming.rename_map(plan, done)), path)
    return mapping.load_mapping(spark, path).select("old", "new")


@query("WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS old, p_name || '.mp3' AS new FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY lower(new) ORDER BY old) AS n FROM b) SELECT old, CASE WHEN n > 1 THEN replace(new, '.mp3', '') || ' (' || n || ').mp3' ELSE new END AS new FROM n")
def q16_collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("old"), F.concat("p_name", F.lit(".mp3")).alias("new"))
    return naming.add_suffixes(rows)


@query(f"WITH {PLANNED_SQL} SELECT count(*) AS total, count(*) FILTER (new <> '' AND new <> old) AS to_rename, count(*) FILTER (new = old) AS already_correct, count(*) FILTER (new = '') AS manual FROM plan")
def q17_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.plan_counts(_plan(spark, sf_dir))


# -- files -----------------------------------------------------------------------------------------


def _hashed(spark: SparkSession, sf_dir: str, strategy: dedup.HashStrategy = dedup.HashStrategy()) -> DataFrame:  # noqa: B008
    return dedup.with_hashes(src.files(spark, sf_dir), strategy)


@query(f"WITH {EXACT_SQL} SELECT ord, size, hash, g1, g2, first_value(ord) OVER (PARTITION BY size, hash ORDER BY rn) AS keeper FROM exact")
def q18_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(_hashed(spark, sf_dir)).select("ord", "size", "hash", "g1", "g2", "keeper")


@query(f"WITH {EXACT_SQL} SELECT ord, size, hash, g1, g2, first_value(ord) OVER (PARTITION BY size, hash ORDER BY rn) AS keeper FROM exact")
def q19_prefix_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = _hashed(spark, sf_dir, dedup.HashStrategy(prefix_gate=True))
    return dedup.exact_groups(gated).select("ord", "size", "hash", "g1", "g2", "keeper")


@query("WITH s AS (SELECT n_chars AS size, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1), p AS (SELECT n_chars AS size, count(*) AS n FROM documents GROUP BY n_chars, encode(text)[1:65536] HAVING count(*) > 1) SELECT (SELECT CAST(coalesce(sum(size * n), 0) AS BIGINT) FROM s) AS whole, (SELECT CAST(coalesce(sum(least(size, 65536) * n), 0) AS BIGINT) FROM s) + (SELECT CAST(coalesce(sum(size * n), 0) AS BIGINT) FROM p) AS gated")
def q19b_bytes_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, gated = (dedup.bytes_hashed(src.files(spark, sf_dir), dedup.HashStrategy(prefix_gate=g)).withColumnRenamed("bytes", n) for n, g in (("whole", False), ("gated", True)))
    return whole.unionByName(gated, allowMissingColumns=True).agg(F.max("whole").alias("whole"), F.max("gated").alias("gated"))


@query(f"WITH {BOTH_SQL} SELECT ord, key, k1 AS g1, first_value(ord) OVER (PARTITION BY key ORDER BY kn) AS keeper FROM keyed WHERE m > 1")
def q20_same_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.song_groups(src.files(spark, sf_dir)).select("ord", "key", "g1", "keeper")


@query(f"WITH {FILES_SQL}, k AS (SELECT artist, ord, ext, size, row_number() OVER (PARTITION BY artist, size % 10 ORDER BY rank DESC, size DESC, ord) AS rn FROM ranked) SELECT artist, ord, ext, size FROM k WHERE rn = 1")
def q21_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min(dedup.keeper_order(F.col("ext"), F.col("dur"), F.col("size"), F.col("ord"))).alias("best")
    kept = src.files(spark, sf_dir).withColumn("m", F.col("size") % 10).groupBy("artist", "m").agg(best).select(F.col("best.ord").alias("ord"))
    return src.files(spark, sf_dir).join(kept, "ord").select("artist", "ord", "ext", "size")


def _dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicates(_hashed(spark, sf_dir))


@query(f"WITH {BOTH_SQL} SELECT grp AS \"group\", CASE pass WHEN 1 THEN 'exact' ELSE 'same-song' END AS kind, CASE rn WHEN 1 THEN 'keep' ELSE 'duplicate' END AS role, path AS file, artist, title, ext, size AS size_bytes FROM dups")
def q22_dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(_dups(spark, sf_dir))


@query(f"WITH {BOTH_SQL} SELECT count(DISTINCT grp) AS groups, count(*) FILTER (rn > 1) AS extras FROM dups")
def q23_dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.summary(dedup.members(_hashed(spark, sf_dir)))


@query(f"WITH {BOTH_SQL} SELECT grp AS \"group\", ord, path FROM dups WHERE rn > 1 AND ord IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q34_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("ord"))
    return dedup.selected(_dups(spark, sf_dir), chosen).select("group", "ord", "path")


@query(f"WITH {NAMES_SQL}, w AS (SELECT p_partkey AS ord, p_name || '.mp3' AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM names WHERE p_partkey % 3 > 0), o AS (SELECT DISTINCT p_name || '.mp3' AS name FROM names WHERE p_partkey % 3 = 0) SELECT w.ord, CASE WHEN n + CASE WHEN o.name IS NULL THEN 0 ELSE 1 END = 1 THEN w.name ELSE replace(w.name, '.mp3', '') || ' (' || CAST(n + CASE WHEN o.name IS NULL THEN 0 ELSE 1 END AS BIGINT) || ').mp3' END AS target FROM w LEFT JOIN o ON o.name = w.name")
def q37_move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(".mp3")))
    extras = rows.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("/music/"), "name").alias("path"))
    return dedup.move_plan(extras, rows.where("p_partkey % 3 = 0").select("name").distinct()).select("ord", "target")


# -- collection ------------------------------------------------------------------------------------

_MAPPING_SQL = "mapping AS (SELECT regexp_extract(url, '([^/\\\\]*)$', 1) AS old, page_id AS ord, CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '([^/\\\\]*)$', 1) ELSE 'Artist ' || page_id % 7 || ' - Title ' || page_id || '.mp3' END AS new FROM pages)"
_RELINK_SQL = f"""{_MAPPING_SQL}, last AS (SELECT old, max_by(new, ord) AS new FROM mapping GROUP BY old),
located AS (SELECT CAST(page_id AS VARCHAR) AS id, url AS path, regexp_extract(url, '^(.*)[/\\\\][^/\\\\]*$', 1) AS dir, regexp_extract(url, '([^/\\\\]*)$', 1) AS old_name FROM pages WHERE contains(url, 'example')),
plan AS (SELECT id AS content_id, old_name, new AS new_name, replace(dir, '\\', '/') || '/' || new AS new_path, trim(substr(replace(new, '.mp3', ''), position(' - ' IN new) + 3)) AS title, trim(split_part(new, ' - ', 1)) AS artist FROM located JOIN last ON old_name = old WHERE new <> old_name)"""


def _paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    name = t.split_path(F.col("url"))[1]
    content = pages.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("path"), name.alias("file_name"), F.lit("").alias("title"), F.lit("").alias("artist"))
    new = F.when(F.col("page_id") % 5 == 0, name).otherwise(F.concat(F.lit("Artist "), (F.col("page_id") % 7).cast("string"), F.lit(" - Title "), F.col("page_id").cast("string"), F.lit(".mp3")))
    return content, pages.select(name.alias("old"), new.alias("new"), F.col("page_id").alias("ord"))


@query(f"WITH {_RELINK_SQL} SELECT * FROM plan")
def q24_mapping_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, renames = _paged(spark, sf_dir)
    return collection.relink_plan(content, renames, "example")


@query(f"WITH {_RELINK_SQL} SELECT id, coalesce(new_path, path) AS path, coalesce(new_name, regexp_extract(path, '([^/\\\\]*)$', 1)) AS file_name, coalesce(new_name, 'S' || id) AS file_name_s, coalesce(p.title, '') AS title, coalesce(p.artist, '') AS artist, CASE WHEN p.artist = 'Artist 3' THEN 'known' WHEN p.artist IS NOT NULL THEN 'new' END AS link FROM (SELECT CAST(page_id AS VARCHAR) AS id, url AS path FROM pages) c LEFT JOIN plan p ON p.content_id = c.id")
def q30_relink_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, renames = _paged(spark, sf_dir)
    content = content.withColumn("file_name_s", F.concat(F.lit("S"), "id")).withColumn("artist_id", F.lit(None).cast("string"))
    plan = collection.relink_plan(content, renames, "example")
    artists = collection.with_artists(spark.createDataFrame([("3", "Artist 3")], "id string, name string"), plan)
    new = collection.apply_relink(content, plan, on_disk=plan.select(F.col("new_path").alias("path")), artists=artists)
    link = F.when(F.col("artist_id") == "3", "known").when(F.col("artist_id").isNotNull(), "new")
    return new.select("id", "path", "file_name", "file_name_s", "title", "artist", link.alias("link"))


def _entries(spark: SparkSession, sf_dir: str, folder: str = "") -> DataFrame:
    return collection.load_entries(*src.collection(spark, sf_dir), folder)


@query(f"WITH {ENTRIES_SQL}, cl AS (SELECT content_id, array_to_string(list_sort(list(id)), ',') AS ids FROM cues GROUP BY 1), pl AS (SELECT content_id, array_to_string(list_sort(list(id)), ',') AS ids FROM playlists GROUP BY 1) SELECT s.id, path, created, plays, rating, comment, file_ext AS ext, coalesce(cl.ids, '') AS cues, coalesce(pl.ids, '') AS playlist_rows FROM songs s LEFT JOIN cl ON cl.content_id = s.id LEFT JOIN pl ON pl.content_id = s.id WHERE contains(lower(path), lower('MUSIC/E'))")
def q25_entry_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, "MUSIC/E")
    lists = F.array_join(F.transform("playlist_rows", lambda r: r["row_id"]), ",")
    return rows.select("id", "path", "created", "plays", "rating", "comment", "ext", F.array_join("cue_ids", ",").alias("cues"), lists.alias("playlist_rows"))


@query(f"WITH {ENTRIES_SQL} SELECT id, CAST(info AS BIGINT) AS info FROM entries")
def q26_info_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("id", collection.info_score().alias("info"))


@query(f"WITH {ENTRIES_SQL} SELECT path_key, count(*) AS n, min(id) AS first FROM songs GROUP BY 1 HAVING count(*) > 1")
def q27_same_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _entries(spark, sf_dir).withColumn("path_key", t.path_key(F.col("path")))
    return keyed.groupBy("path_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")


def _coll_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.duplicates(_entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL} SELECT grp AS \"group\", CASE pass WHEN 1 THEN 'same-file' ELSE 'same-song' END AS kind, CASE rn WHEN 1 THEN 'keep' ELSE 'remove' END AS role, id AS entry_id, path, CAST(n_cues AS INTEGER) AS cues, CAST(n_lists AS INTEGER) AS playlists, plays, rating, created FROM grouped")
def q28_coll_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.report(_coll_dups(spark, sf_dir))


_MERGE_SQL = f"""{ENTRIES_SQL},
pm AS (SELECT p.*, g.keeper, g.rn FROM playlists p LEFT JOIN grouped g ON g.id = p.content_id),
pr AS (SELECT *, row_number() OVER (PARTITION BY keeper, playlist_id ORDER BY rn, id) AS place, count(*) FILTER (rn = 1) OVER (PARTITION BY keeper, playlist_id) AS own FROM pm),
new_playlists AS (SELECT id, playlist_id, CASE WHEN keeper IS NULL THEN content_id ELSE keeper END AS content_id FROM pr WHERE keeper IS NULL OR rn = 1 OR (own = 0 AND place = 1)),
cm AS (SELECT c.*, g.keeper, g.rn, min(g.rn) OVER (PARTITION BY g.keeper) AS donor FROM cues c LEFT JOIN grouped g ON g.id = c.content_id),
new_cues AS (SELECT id, CASE WHEN keeper IS NULL THEN content_id ELSE keeper END AS content_id FROM cm WHERE keeper IS NULL OR rn = donor)"""


@query(f"WITH {_MERGE_SQL} SELECT 'content' AS tab, id, '' AS content_id FROM content WHERE id NOT IN (SELECT id FROM grouped WHERE rn > 1) UNION ALL SELECT 'cue', id, content_id FROM new_cues UNION ALL SELECT 'playlist', id, content_id FROM new_playlists")
def q29_merge_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, cues, playlists = src.collection(spark, sf_dir)
    new = collection.merge(_coll_dups(spark, sf_dir), content, cues, playlists)
    rows = new["content"].select(F.lit("content").alias("tab"), "id", F.lit("").alias("content_id"))
    return rows.unionByName(new["cues"].select(F.lit("cue").alias("tab"), "id", "content_id")).unionByName(new["playlists"].select(F.lit("playlist").alias("tab"), "id", "content_id"))


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return src.collection(spark, sf_dir)[0].join(labelled, "id", "left_semi").select("path").distinct()


@query(f"WITH {ENTRIES_SQL}, disk AS (SELECT path FROM content WHERE ord IN (SELECT doc_id FROM labels)), gone AS (SELECT id, path FROM songs WHERE path NOT IN (SELECT path FROM disk)) SELECT (SELECT count(*) FROM gone) AS missing, (SELECT array_to_string(list(path ORDER BY id), chr(10)) FROM (SELECT * FROM gone ORDER BY id LIMIT 5)) AS sample")
def q31_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.missing_sample(_entries(spark, sf_dir), _disk(spark, sf_dir), "id")


def _health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: aggregates of one row each, brought together by name."""
    plan = naming.plan_counts(_plan(spark, sf_dir)).select(F.col("to_rename").alias("rename_issues"), F.col("manual").alias("manual_review"))
    dups = dedup.summary(dedup.members(_hashed(spark, sf_dir))).select(F.col("groups").alias("file_groups"), F.col("extras").alias("file_extras"))
    coll = collection.summary(collection.members(_entries(spark, sf_dir))).select(F.col("groups").alias("collection_groups"), F.col("extras").alias("collection_extras"))
    gone = collection.missing(_entries(spark, sf_dir), _disk(spark, sf_dir)).agg(F.count(F.lit(1)).alias("missing_files"))
    rows = plan
    for part in (dups, coll, gone):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in health.COUNTS]).select("*", F.lit(True).alias("configured"), F.lit(True).alias("exists"), F.lit(False).alias("running"), F.lit(None).cast("string").alias("error"))


_HEALTH_CTE = f"""{ENTRIES_SQL}, disk AS (SELECT path FROM content WHERE ord IN (SELECT doc_id FROM labels))"""
_HEALTH_SQL = f"""WITH p AS (WITH {PLANNED_SQL} SELECT count(*) FILTER (new <> '' AND new <> old) AS rename_issues, count(*) FILTER (new = '') AS manual_review FROM plan),
f AS (WITH {BOTH_SQL} SELECT count(DISTINCT grp) AS file_groups, count(*) FILTER (rn > 1) AS file_extras FROM dups),
c AS (WITH {_HEALTH_CTE} SELECT count(DISTINCT grp) AS collection_groups, count(*) FILTER (rn > 1) AS collection_extras FROM grouped),
m AS (WITH {_HEALTH_CTE} SELECT count(*) AS missing_files FROM songs WHERE path NOT IN (SELECT path FROM disk)),
h AS (SELECT *, CAST(greatest(0, 100 - least(rename_issues // 20, 20) - least(file_extras // 10 * 2, 25) - least(missing_files // 10 * 2, 30) - least(collection_groups, 15)) AS INTEGER) AS score FROM p, f, c, m)"""


@query(f"{_HEALTH_SQL} SELECT rename_issues, manual_review, file_groups, file_extras, missing_files, collection_groups, collection_extras, score, CASE WHEN score >= 90 THEN 'Healthy' WHEN score >= 60 THEN 'Needs attention' ELSE 'Critical' END AS label FROM h")
def q32_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.report(_health_counts(spark, sf_dir)).select(*health.COUNTS, "score", "label")


@query(f"{_HEALTH_SQL}, i AS (SELECT 1 AS place, 'rename-issues' AS code, 'warning' AS severity, rename_issues AS count, rename_issues > 0 AS there FROM h UNION ALL SELECT 2, 'manual-review', 'warning', manual_review, manual_review > 0 FROM h UNION ALL SELECT 3, 'file-duplicates', 'warning', file_extras, file_groups > 0 FROM h UNION ALL SELECT 4, 'missing-files', 'critical', missing_files, missing_files > 0 FROM h UNION ALL SELECT 5, 'collection-duplicates', 'warning', collection_extras, collection_groups > 0 FROM h) SELECT place, code, severity, count FROM i WHERE there")
def q32b_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.issues(_health_counts(spark, sf_dir))


_STATES = {"rename_issues": "c_custkey % 60", "manual_review": "c_custkey % 3", "file_groups": "c_custkey % 5", "file_extras": "c_custkey % 90", "missing_files": "c_custkey % 170 - 100", "collection_groups": "c_custkey % 21", "collection_extras": "c_custkey % 21 * 2"}
_FLAGS = {"configured": "c_custkey % 2 = 0", "exists": "c_custkey % 7 < 4", "running": "c_custkey % 11 < 3", "error": "CASE WHEN c_custkey % 13 < 4 THEN 'locked' END"}
_STATES_SQL = f"states AS (SELECT c_custkey, {', '.join(f'CAST(greatest({x}, 0) AS BIGINT) AS {n}' for n, x in _STATES.items())}, {', '.join(f'{x} AS {n}' for n, x in _FLAGS.items())} FROM customer)"
_EACH_ISSUE = [("rename-issues", "warning", "rename_issues", "rename_issues > 0"), ("manual-review", "warning", "manual_review", "manual_review > 0"), ("file-duplicates", "warning", "file_extras", "file_groups > 0"), ("missing-files", "critical", "missing_files", "missing_files > 0"), ("collection-duplicates", "warning", "collection_extras", "collection_groups > 0"), ("collection-unavailable", "warning", "1", "NOT exists AND configured"), ("collection-not-configured", "warning", "1", "NOT exists AND NOT configured"), ("collection-running", "info", "1", "exists AND running"), ("collection-inspection", "warning", "1", "exists AND NOT running AND error IS NOT NULL")]
_ISSUES_SQL = " UNION ALL ".join(f"SELECT c_custkey, {i} AS place, '{code}' AS code, '{severity}' AS severity, CAST({n} AS BIGINT) AS count FROM states WHERE {there}" for i, (code, severity, n, there) in enumerate(_EACH_ISSUE, 1))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and flags of many libraries, in all combinations."""
    counts = [F.greatest(F.expr(x), F.lit(0)).cast("long").alias(n) for n, x in _STATES.items()]
    return table(spark, sf_dir, "customer").select("c_custkey", *counts, *[F.expr(x).alias(n) for n, x in _FLAGS.items()])


@query(f"WITH {_STATES_SQL}, h AS (SELECT c_custkey, CAST(greatest(0, 100 - least(rename_issues // 20, 20) - least(file_extras // 10 * 2, 25) - least(missing_files // 10 * 2, 30) - CASE WHEN configured AND NOT exists THEN 5 ELSE 0 END - least(collection_groups, 15)) AS INTEGER) AS score FROM states) SELECT c_custkey, score, CASE WHEN score >= 90 THEN 'Healthy' WHEN score >= 60 THEN 'Needs attention' ELSE 'Critical' END AS label FROM h")
def q32c_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.report(_states(spark, sf_dir)).select("c_custkey", "score", "label")


@query(f"WITH {_STATES_SQL}, i AS ({_ISSUES_SQL}), all_ AS (SELECT place, code, severity, count FROM i UNION ALL SELECT 1, 'healthy', 'info', 0 FROM states WHERE c_custkey NOT IN (SELECT c_custkey FROM i)) SELECT place, code, severity, count, count(*) AS libraries FROM all_ GROUP BY ALL")
def q32d_issue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.issues(_states(spark, sf_dir)).groupBy("place", "code", "severity", "count").agg(F.count(F.lit(1)).alias("libraries"))


# -- tags ------------------------------------------------------------------------------------------


@query(f"WITH {NAMES_SQL}, n AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN ' - .mp3' ELSE name END AS name FROM names), s AS (SELECT CASE WHEN NOT regexp_matches(lower(name), '[.](wav|mp3|aiff|aif|aifc)$') THEN 'skip-ext' WHEN name = ' - .mp3' THEN 'skip-noname' ELSE 'ok' END AS status FROM n) SELECT status, count(*) AS n FROM s GROUP BY 1")
def q33_status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 11 == 0, " - .mp3").otherwise(F.col("name"))
    return codec.tally(src.names(spark, sf_dir).select(codec.predicted_status(name).alias("status")))


_OLD_TAG, _OLD_INFO = codec.id3_tag("Old", "Tag" * 9), codec.info_chunk("Old", "Tag")


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from whole texts, WAV, AIFF and MP3 in turn: some with old tags, in front of their audio
    or behind it, some broken, without a name or with the extension of no format that is written.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("s")).where("s <> ''")
    kind, odd = F.col("doc_id") % 3, F.col("doc_id") % 7
    size = F.octet_length("s")
    body = F.concat(F.col("s").cast("binary"), F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    big = F.unhex(F.lpad(F.hex(size), 8, "0"))
    little = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(size), 8, "0"), F.lit("(..)"), F.lit(1))), ""))
    head = lambda text: F.concat(F.lit(text[:4]).cast("binary"), F.unhex(F.lit("00000000")), F.lit(text[4:]).cast("binary"))
    around = lambda whole, tag: F.when(odd == 1, F.concat(whole[0], F.lit(tag), *whole[1:])).when(odd == 2, F.concat(*whole, F.lit(tag))).otherwise(F.concat(*whole))
    wav = around((head("RIFFWAVE"), F.lit("data").cast("binary"), little, body), _OLD_INFO)
    aiff = around((head("FORMAIFF"), F.lit("SSND").cast("binary"), big, body), codec.chunk(b"ID3 ", _OLD_TAG, ">"))
    audio = F.concat(F.unhex(F.lit("FFFB9000")), F.col("s").cast("binary"))
    mp3 = F.when(odd.isin(1, 2), F.concat(F.lit(_OLD_TAG), audio)).otherwise(audio)
    content = F.when(kind == 2, mp3).when(odd == 3, F.lit(b"neither of both")).when(kind == 0, wav).otherwise(aiff)
    ext = F.when(odd == 4, ".flac").when(kind == 0, ".wav").when(kind == 1, ".aif").otherwise(".mp3")
    folder = F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit("/"))
    name = F.when(odd == 5, " - ").otherwise(F.concat(F.lit("Artist "), (F.col("doc_id") % 9).cast("string"), F.lit(" - Song "), F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.concat(folder, name, ext).alias("path"), content.alias("content"))


_CHUNKS_SQL = f"""files AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data' ELSE 'SSND' END AS id, CASE doc_id % 3 WHEN 0 THEN 'LIST' ELSE 'ID3 ' END AS tag, strlen(text) AS size, doc_id % 7 AS odd,
                  CASE doc_id % 3 WHEN 0 THEN {len(_OLD_INFO) - 8} ELSE {len(_OLD_TAG)} END AS tag_size FROM documents WHERE doc_id % 3 < 2 AND doc_id % 7 <> 3 AND strlen(text) > 0)"""


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, id, CAST(CASE odd WHEN 1 THEN 20 + tag_size + tag_size % 2 ELSE 12 END AS BIGINT) AS pos, CAST(size AS BIGINT) AS size FROM files UNION ALL SELECT doc_id, tag, CAST(CASE odd WHEN 1 THEN 12 ELSE 20 + size + size % 2 END AS BIGINT), tag_size FROM files WHERE odd IN (1, 2)")
def q35_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("chunk_table", codec.ChunkTable)
    return spark.sql("SELECT doc_id, c.id, c.pos, c.size FROM {files}, LATERAL chunk_table(content) c", files=_media(spark, sf_dir))


@query("WITH f AS (SELECT *, CASE WHEN doc_id % 7 = 4 THEN 'skip-ext' WHEN doc_id % 7 = 5 THEN 'skip-noname' WHEN doc_id % 7 = 3 AND doc_id % 3 < 2 THEN 'error' ELSE 'ok' END AS status FROM documents WHERE strlen(text) > 0) SELECT '/m/' || doc_id || '/' || CASE WHEN doc_id % 7 = 5 THEN ' - ' ELSE 'Artist ' || doc_id % 9 || ' - Song ' || doc_id END || CASE WHEN doc_id % 7 = 4 THEN '.flac' WHEN doc_id % 3 = 0 THEN '.wav' WHEN doc_id % 3 = 1 THEN '.aif' ELSE '.mp3' END AS path, status, CASE status WHEN 'ok' THEN 'Artist ' || doc_id % 9 END AS artist, CASE status WHEN 'ok' THEN 'Song ' || doc_id END AS title, CASE WHEN status <> 'ok' THEN 0 WHEN doc_id % 3 = 2 THEN 1 ELSE 2 END AS parts FROM f")
def q36_tag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parts`` is how many chunks a file has then: its audio and one tag, whatever it had before."""
    tagged = codec.tag_files(_media(spark, sf_dir)).withColumn("tags", codec.tags_of("content"))
    return tagged.select("path", "status", "tags.artist", "tags.title", F.coalesce(codec.part_count("content"), F.lit(0)).alias("parts"))


@query("SELECT doc_id, CASE WHEN n_chars > 1048576 THEN printf('%.1f MB', n_chars / 1048576.0) ELSE CAST(ceil(n_chars / 1024.0) AS BIGINT) || ' KB' END AS shown FROM documents")
def q38_human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.human_size(F.col("n_chars")).alias("shown"))

