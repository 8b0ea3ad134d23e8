"""DuckDB SQL that states what each query returns. Fixed values (kinds by extension, letters without marks) are the engine's own tables."""

from __future__ import annotations

from pathsonde.functions import kinds
from pathsonde.functions.text import fold_sql, unaccent_folded_sql
from pathsonde.sources.entries import NOW, SAMPLE_EXTENSIONS, SAMPLE_MODES

SLUG = "regexp_replace(substr(text, 1, 16), '[^\\p{L}\\p{N}]+', '_', 'g')"
HOST = "rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')"
DOC_PATH = f"'/corpus/' || source || '/' || lang || '/' || {SLUG} || '_' || doc_id || '.txt'"
PAGE_PATH = f"'/web/' || {HOST} || '/page_' || page_id || '.html'"
CHAT_PATH = "'/chats/c' || conv_id || '/' || turn || '_' || role || '.md'"


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + "]"


PART_EXT = f"({_list(SAMPLE_EXTENSIONS)})[CAST(p_partkey % {len(SAMPLE_EXTENSIONS)} AS INT) + 1]"
RAW = f"""
  SELECT 0 AS source, {DOC_PATH} AS path, doc_id AS key, n_chars AS size, 1700000000 + doc_id * 7919 % 63072000 AS mtime FROM documents
  UNION ALL SELECT 1, {PAGE_PATH}, page_id, length(html), 1704067200 + 3600 * page_id FROM pages
  UNION ALL SELECT 2, '/orders/' || o_orderstatus || '/' || replace(o_orderpriority, ' ', '_') || '/' || strftime(o_orderdate, '%Y') || '/order_' || o_orderkey || '.csv',
    o_orderkey, CAST(floor(o_totalprice) AS BIGINT), CAST(epoch(o_orderdate) AS BIGINT) FROM orders
  UNION ALL SELECT 3, '/parts/' || replace(p_brand, '#', '') || '/' || p_type || CASE WHEN p_partkey % 97 = 0 THEN '/.gitignore_d' || p_partkey || '/.rs'
      WHEN p_partkey % 89 = 0 THEN '/README_' || p_partkey
      ELSE '/' || replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN {PART_EXT} = '' THEN '' ELSE '.' || {PART_EXT} END END,
    p_partkey, CASE WHEN p_partkey % 53 = 0 THEN 0 ELSE CAST(floor(round(p_retailprice * 100, 4)) AS BIGINT) END, 1690000000 + 60 * p_partkey FROM part
  UNION ALL SELECT 4, {CHAT_PATH}, conv_id, length(text), 1695000000 + 60 * conv_id + turn FROM conversations"""


def _kind() -> str:
    by_ext = " ".join(f"WHEN extc IN ({', '.join(repr(e) for e, k in kinds.extensions().items() if k == kind)}) THEN {kinds.NUMBER[kind]}" for kind in kinds.KINDS if kind in kinds.extensions().values())
    names = " ".join(f"WHEN cased IN ({', '.join(map(repr, w.split()))}) THEN {kinds.NUMBER[k]}" for k, w in kinds.NAMES.items())
    starts = " ".join(f"WHEN starts_with(cased, '{w}') THEN {kinds.NUMBER[k]}" for w, k in kinds.BEGINNINGS)
    stem = "substr(cased, 1, length(cased) - length(extc) - 1)"
    page = f"extc IN ('html', 'htm') AND (contains({stem}, '.') OR {stem} IN ({', '.join(map(repr, kinds.GENERATED))}))"
    rest = "CASE WHEN mode & 73 <> 0 THEN 6 ELSE 0 END"
    return f"CASE WHEN is_dir THEN 1 WHEN extc = '' THEN coalesce(CASE {names} {starts} END, {rest}) WHEN {page} THEN 10 ELSE coalesce(CASE {by_ext} END, {rest}) END"


#: Everything up to the relation ``entries``; queries continue it.
ENTRIES = f"""WITH raw AS ({RAW}),
files AS (SELECT source, path, false AS is_dir, CAST(size AS BIGINT) AS size, CAST(mtime AS BIGINT) AS mtime, CAST(mtime - key % 1000 AS BIGINT) AS ctime,
  CAST(mtime + key % 86400 AS BIGINT) AS atime, CAST(({_list(SAMPLE_MODES)})[CAST(key % 5 AS INT) + 1] AS BIGINT) AS mode, CAST(1000 + key % 5 AS BIGINT) AS uid,
  CAST(1000 + key % 5 AS BIGINT) AS gid, CAST((size + 4095) // 4096 * 4096 AS BIGINT) AS disk, CAST(-1 AS BIGINT) AS items, CAST(1 + key % 3 AS BIGINT) AS links FROM raw),
cuts AS (SELECT source, mtime, string_split(path, '/') AS p, unnest(range(2, len(string_split(path, '/')))) AS i FROM files),
dirs AS (SELECT source, array_to_string(p[1:i], '/') AS path, true AS is_dir, CAST(0 AS BIGINT) AS size, max(mtime) AS mtime, max(mtime) AS ctime, max(mtime) AS atime,
  CAST(16877 AS BIGINT) AS mode, CAST(1000 AS BIGINT) AS uid, CAST(1000 AS BIGINT) AS gid, CAST(0 AS BIGINT) AS disk, CAST(-1 AS BIGINT) AS items, CAST(1 AS BIGINT) AS links FROM cuts GROUP BY ALL),
stored AS (SELECT * FROM files UNION ALL SELECT * FROM dirs),
named AS (SELECT *, string_split(path, '/')[-1] AS name FROM stored),
folded AS (SELECT *, {fold_sql("name")} AS cased, substr(path, 1, greatest(length(path) - length(name) - 1, CASE WHEN path LIKE '/%' THEN 1 ELSE 0 END)) AS parent,
  {fold_sql("CASE WHEN NOT is_dir AND contains(name, '.') AND strlen(string_split(name, '.')[-1]) <= 12 AND length(name) > length(string_split(name, '.')[-1]) + 1 THEN string_split(name, '.')[-1] ELSE '' END")} AS extc FROM named),
entries AS (SELECT * EXCLUDE (extc), {unaccent_folded_sql("cased")} AS bare, {unaccent_folded_sql("extc")} AS ext, CAST({_kind()} AS INT) AS kind,
  CAST(length(path) - length(replace(path, '/', '')) AS BIGINT) AS depth FROM folded)
"""
#: The same, with the contents of sources that have any.
CONTENTS = ENTRIES + f""", contents AS (SELECT 0 AS source, {DOC_PATH} AS path, text AS content FROM documents
  UNION ALL SELECT 1, {PAGE_PATH}, html FROM pages UNION ALL SELECT 4, {CHAT_PATH}, text FROM conversations)
"""
PATH_BARE = unaccent_folded_sql(fold_sql("path"))
TOKENS = _list(kinds.KINDS)
SHOWN = "source, path, size, mtime"
DAY = 86_400


def where(condition: str) -> str:
    return f"{ENTRIES} SELECT {SHOWN} FROM entries WHERE {condition}"


def near_sql(term: str) -> str:
    swaps = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)}
    close = " OR ".join(f"len(list_filter(range(1, length(bare) + 1), lambda i: levenshtein(substr(bare, i, {m}), '{term}') <= 1)) > 0" for m in range(len(term) - 1, len(term) + 2))
    return f"({close} OR " + " OR ".join(f"contains(bare, '{s}')" for s in sorted(swaps)) + ")"


def near_two_sql(term: str) -> str:
    close = " OR ".join(f"len(list_filter(range(1, length(bare) + 1), lambda i: damerau_levenshtein(substr(bare, i, {m}), '{term}') <= 2)) > 0" for m in range(len(term) - 2, len(term) + 3))
    return f"({close})"


#: Query text and what it means.
PREDICATES: dict[str, tuple[str, str]] = {
    "pred_name": ("Bolt", "contains(bare, 'bolt')"),
    "pred_glob": ("red_*_1?.*", "bare LIKE 'red\\_%\\_1_.%' ESCAPE '\\'"),
    "pred_glob_ext": ("*.rs", "bare LIKE '%.rs'"),
    "pred_phrase": ('"order_1*"|"order_12"', "contains(bare, 'order_1*') OR contains(bare, 'order_12')"),
    "pred_path": ("brand1/small", f"contains({PATH_BARE}, 'brand1/small')"),
    "pred_path_field": ("path:CORPUS", f"contains({PATH_BARE}, 'corpus')"),
    "pred_under": ("under:/parts/Brand1/", "starts_with(path, '/parts/Brand1/') AND path <> '/parts/Brand1/'"),
    "pred_under_unknown": ("in:/nowhere/at/all", "false"),
    "pred_parent": ("parent:/parts", "parent = '/parts'"),
    "pred_parent_root": ("child:/", "parent = '/'"),
    "pred_ext_list": ("ext:rs;JPG;.md", "NOT is_dir AND ext IN ('rs', 'jpg', 'md')"),
    "pred_folder": ("folder:", "is_dir"),
    "pred_file": ("!folder:", "NOT is_dir"),
    "pred_size": ("size:1.5kb", "size >= 1536"),
    "pred_size_range": ("size:100kb..200kb", "size >= 102400 AND size <= 204800"),
    "pred_kind": ("kind:media|tür:kod", "kind IN (7, 8, 9) OR kind = 2"),
    "pred_time_day": ("dm:1996-01-02", "mtime >= 820540800 AND mtime < 820627200"),
    "pred_time_window": ("modified:>3y", f"mtime > {NOW - 1095 * DAY}"),
    "pred_time_created": ("dc:<=2024-01-15", "ctime <= 1705276800"),
    "pred_time_accessed": ("da:2024-02-01..", "atime >= 1706745600"),
    "pred_depth": ("depth:4", "depth = 4"),
    "pred_depth_more": ("derinlik:>4", "depth > 4"),
    "pred_regex": (r'regex:"_1[0-9]+\.(rs|py)$"', r"regexp_matches(bare, '_1[0-9]+\.(rs|py)$')"),
    "pred_len": ("len:>25", "length(name) > 25"),
    "pred_case": ("case:JPG", "contains(name, 'JPG')"),
    "pred_letters": ("letters:rwd3", "bare LIKE '%r%w%d%3%'"),
    "pred_user": ("user:1003", "uid = 1003"),
    "pred_group": ("group:1002", "gid = 1002"),
    "pred_bits_any": ("perm:/022", "mode & 18 <> 0"),
    "pred_bits_all": ("perm:-755", "mode & 493 = 493"),
    "pred_bits_exact": ("izin:644", "mode & 4095 = 420"),
    "pred_node": ("node:link", "mode & 61440 = 40960"),
    "pred_suid": ("suid:", "mode & 2048 = 2048"),
    "pred_ww": ("ww:", "mode & 2 <> 0"),
    "pred_empty": ("empty:", "NOT is_dir AND size = 0"),
    "pred_startwith": ("startwith:small", "bare LIKE 'small%'"),
    "pred_endwith": ("endwith:7.csv", "bare LIKE '%7.csv'"),
    "pred_and_or_not": ("red|blue !ext:pdf;rs size:>50kb", "(contains(bare, 'red') OR contains(bare, 'blue')) AND NOT (NOT is_dir AND ext IN ('pdf', 'rs')) AND size > 51200"),
    "pred_negated_range": ("!size:200kb..100kb", "NOT size >= 204800 AND NOT size <= 102400"),
    "pred_negated_alternative": ("!red|bolt", "NOT contains(bare, 'red') OR contains(bare, 'bolt')"),
    "pred_macro": ("pic:|audio:", "kind = 3"),
    "pred_semicolon": ("red;bolt", "contains(bare, 'red') AND contains(bare, 'bolt')"),
    "pred_bang": ("bolt!red", "contains(bare, 'bolt') AND NOT contains(bare, 'red')"),
    "pred_group_of": ("( red | blue ) bolt", "(contains(bare, 'red') OR contains(bare, 'blue')) AND contains(bare, 'bolt')"),
    "pred_unreadable": ("kind:zurna|zurna:5|red_ring", "contains(bare, 'kind:zurna') OR contains(bare, 'zurna:5') OR contains(bare, 'red_ring')"),
    "pred_no_extensions": ("ext:", "false"),
    "pred_accent_plain": ("cion", "contains(bare, 'cion')"),
    "pred_accent_marked": ("CIÓN", "contains(cased, 'ción')"),
    "pred_fuzzy_1": ("fuzzy:anvli", near_sql("anvli")),
    "pred_fuzzy_long": ("typo:wigdet", near_sql("wigdet")),
}
ORACLE = {name: where(sql) for name, (_, sql) in PREDICATES.items()}
ORACLE["pred_fuzzy_2"] = where(near_two_sql("smlal_wdiget"))
ORACLE["pred_exact_accents"] = where("contains(cased, 'on')")

SORT_FILTER = "contains(bare, 'bolt') OR is_dir OR (NOT is_dir AND ext = 'mp3') OR kind = 5"
SORT_KEYS = {"name": "bare", "path": "path", "size": "size", "modified": "mtime", "created": "ctime", "accessed": "atime", "ext": "ext", "kind": "kind", "mode": "mode", "uid": "uid", "gid": "gid", "disk": "disk"}
for _sort, _key in SORT_KEYS.items():
    for _way in ("asc", "desc"):
        ORACLE[f"sort_{_sort}_{_way}"] = f"""{ENTRIES} SELECT CAST(row_number() OVER (ORDER BY {_key} {_way}, mtime DESC, path) AS INT) AS rank, path FROM entries
          WHERE {SORT_FILTER} QUALIFY rank <= 60"""
ORACLE["page_offset"] = f"""{ENTRIES} SELECT CAST(row_number() OVER (ORDER BY size DESC, mtime DESC, path) - 120 AS INT) AS rank, path FROM entries QUALIFY rank BETWEEN 1 AND 40"""
ORACLE["page_after"] = ORACLE["page_offset"]
ORACLE["search_flagship"] = f"""{ENTRIES} SELECT CAST(row_number() OVER (ORDER BY mtime DESC, path) AS INT) AS rank, path, size, mtime FROM entries
  WHERE NOT is_dir AND ext = 'csv' AND size > 102400 QUALIFY rank <= 40"""
_GENERATED = "('target', 'build', 'out', 'dist', 'node_modules', 'vendor', '__pycache__', 'site-packages', 'obj', '.gradle', 'cmakefiles')"
_STEPS = f"least(60, list_sum(list_transform(list_filter(string_split(parent, '/'), lambda x: x <> ''), lambda x: CASE WHEN starts_with(x, '.') OR lower(x) IN {_GENERATED} THEN 3 ELSE 1 END)))"


def _rung(t: str) -> str:
    dot = "length(bare) - length(string_split(bare, '.')[-1])"
    at = f"instr(bare, '{t}')"
    return f"""CASE WHEN {at} = 0 THEN 0 WHEN contains(bare, '.') AND {dot} > 1 AND substr(bare, 1, {dot} - 1) = '{t}' THEN 4000 WHEN bare = '{t}' THEN 3000 WHEN {at} = 1 THEN 2000
      WHEN NOT regexp_matches(substr(bare, {at} - 1, 1), '^[A-Za-z0-9]$') THEN 1000 ELSE 100 END"""


def _score(*terms: str) -> str:
    best = f"greatest({', '.join(map(_rung, terms))})" if len(terms) > 1 else _rung(terms[0])
    return f"CAST({best} - least(255, strlen(bare)) - 8 * coalesce({_STEPS}, 0) AS BIGINT)"


for _name, _terms in (("relevance", ("bolt",)), ("relevance_terms", ("bolt", "red")), ("relevance_folder", ("small",))):
    _where = " AND ".join(f"contains(bare, '{t}')" for t in _terms)
    ORACLE[_name] = f"""{ENTRIES} SELECT CAST(row_number() OVER (ORDER BY {_score(*_terms)} DESC, mtime DESC, path) AS INT) AS rank, path, {_score(*_terms)} AS relevance FROM entries
      WHERE {_where} QUALIFY rank <= 100"""
ORACLE["count_all"] = f"{ENTRIES} SELECT least(count(*), 1000000000) AS total, count(*) >= 1000000000 AS capped FROM entries"
ORACLE["count_capped"] = f"{ENTRIES} SELECT least(count(*), 100) AS total, count(*) >= 100 AS capped FROM entries WHERE contains(bare, 'bolt')"
ORACLE["similar_count"] = f"{ENTRIES} SELECT least(count(*), 1000) AS total FROM entries WHERE {near_sql('anvli')}"
ORACLE["scan_entries"] = f"{ENTRIES} SELECT source, path, is_dir, size, mtime, ctime, atime, mode, uid, gid, disk, items, links FROM entries"
ORACLE["derived_columns"] = f"{ENTRIES} SELECT source, path, name, parent, ext, kind, depth, cased, bare FROM entries"
ORACLE["entry_stat"] = f"{ENTRIES} SELECT {SHOWN}, is_dir FROM entries WHERE path = '/parts/Brand1'"
ORACLE["index_stats"] = f"{ENTRIES} SELECT count(*) AS entries, CAST(sum(CAST(is_dir AS BIGINT)) AS BIGINT) AS directories FROM entries"
_X = lambda shift, special, yes, no: f"CASE WHEN mode & {special} <> 0 AND mode & {1 << shift} <> 0 THEN '{yes}' WHEN mode & {special} <> 0 THEN '{no}' WHEN mode & {1 << shift} <> 0 THEN 'x' ELSE '-' END"
_RW = lambda shift: f"CASE WHEN mode & {4 << shift} <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & {2 << shift} <> 0 THEN 'w' ELSE '-' END"
MODE = f"""CASE WHEN mode & 61440 = 40960 THEN 'l' WHEN is_dir THEN 'd' ELSE '-' END || {_RW(6)} || {_X(6, 2048, "s", "S")} || {_RW(3)} || {_X(3, 1024, "s", "S")} || {_RW(0)} || {_X(0, 512, "t", "T")}"""
ORACLE["mode_string"] = f"{ENTRIES} SELECT source, path, {MODE} AS perm FROM entries"
ORACLE["owner_join"] = f"""{ENTRIES} SELECT source, path, coalesce(u.n_name, CAST(uid AS VARCHAR)) AS "user", coalesce(g.n_name, CAST(gid AS VARCHAR)) AS "group" FROM entries
  LEFT JOIN nation u ON u.n_nationkey + 1001 = uid LEFT JOIN nation g ON g.n_nationkey + 1002 = gid"""
ORACLE["export_cells"] = f"""{ENTRIES} SELECT name, parent AS path, path AS "full", ext, CAST(size AS VARCHAR) AS size, CASE WHEN mtime > 0 THEN strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS mtime,
  ({TOKENS})[kind + 1] AS kind, {MODE} AS perm, CAST(uid AS VARCHAR) AS "user", '' AS items, '' AS nonsense FROM entries WHERE contains(bare, 'bolt')"""
ORACLE["runs_when_opened"] = f"{ENTRIES} SELECT path FROM entries WHERE NOT is_dir AND (kind = 6 OR ext IN ('desktop', 'sh', 'bash', 'zsh', 'ksh', 'fish', 'ps1', 'scr', 'lnk', 'vbs', 'wsf', 'jar'))"
ORACLE["turkish_upper"] = f"{ENTRIES} SELECT source, path, upper(replace(replace(name, 'i', 'İ'), 'ß', 'SS')) AS upper FROM entries"


def _facet(question: str, key: str, extra: str = "true", top: int | None = 20, filt: str = "true") -> str:
    cut = "" if top is None else f"QUALIFY row_number() OVER (ORDER BY count DESC, key) <= {top}"
    return f"""SELECT question, key, count FROM (SELECT '{question}' AS question, {key} AS key, count(*) AS count FROM entries WHERE ({filt}) AND {extra} GROUP BY ALL) {cut}"""


def _age(edges: list[int]) -> str:
    days = f"(greatest(0, {NOW} - mtime) // {DAY})"
    return "CASE " + " ".join(f"WHEN {days} <= {e} THEN '{e}'" for e in edges) + " ELSE 'older' END"


AGES = [30, 365, 800, 1000, 4000]
KIND_KEY = f"({TOKENS})[kind + 1]"
CHILD_KEY = "string_split(substr(path, 8), '/')[1]"
ORACLE["facet_kind"] = f"{ENTRIES} {_facet('kind', KIND_KEY, top=16)}"
ORACLE["facet_ext"] = f"{ENTRIES} {_facet('ext', 'ext', "ext <> ''", top=5)}"
ORACLE["facet_dir"] = f"{ENTRIES} {_facet('dir:/parts', CHILD_KEY, "starts_with(path, '/parts/')", top=10)}"
_AGE_Q = "age:" + ",".join(map(str, AGES))
ORACLE["facet_age"] = f"{ENTRIES} {_facet(_AGE_Q, _age(AGES), top=None)}"
ORACLE["facets_multi"] = ENTRIES + " UNION ALL ".join(
    f"({x})" for x in (_facet("kind", KIND_KEY, top=16, filt="contains(bare, 'bolt')"), _facet("ext", "ext", "ext <> ''", 20, "contains(bare, 'bolt')"), _facet("dir:/parts", CHILD_KEY, "starts_with(path, '/parts/')", 20, "contains(bare, 'bolt')"), _facet(_AGE_Q, _age(AGES), "true", None, "contains(bare, 'bolt')"))
)
ORACLE["facets_sideways"] = ENTRIES + " UNION ALL ".join(
    f"({x})" for x in (_facet("kind", KIND_KEY, top=16, filt=f"contains(bare, 'bolt') AND mtime >= {NOW - 1200 * DAY}"), _facet(_AGE_Q, _age(AGES), "true", None, "contains(bare, 'bolt') AND kind = 2"))
)
RIBBON = [8, 17, 27, 38, 50, 63, 78, 94, 111, 131, 152, 175, 201, 230, 261, 295, 333, 375, 421, 471, 527, 588, 656, 730]
ORACLE["age_ribbon"] = f"{ENTRIES} {_facet('age:' + ','.join(str(e) for e in RIBBON), _age(RIBBON), top=None)}"

_BANDS = (1, 7, 30, 180, 365)


def _totals(bytes_: str = "size // greatest(links, 1)") -> str:
    days = f"(({NOW} - mtime) / {DAY}.0)"
    low = [None, *_BANDS]
    out = [f"CAST(coalesce(sum({bytes_}), 0) AS BIGINT) AS bytes", "CAST(coalesce(sum(disk // greatest(links, 1)), 0) AS BIGINT) AS disk", "count(*) AS files"]
    for k in range(6):
        cond = " AND ".join(x for x in (f"{days} >= {low[k]}" if low[k] is not None else "", f"{days} < {_BANDS[k]}" if k < 5 else "") if x)
        out.append(f"CAST(coalesce(sum(CASE WHEN {cond} THEN {bytes_} ELSE 0 END), 0) AS BIGINT) AS age{k}")
    return ", ".join(out)


ORACLE["usage_root"] = f"{ENTRIES} SELECT '/parts' AS path, {_totals()} FROM entries WHERE NOT is_dir AND starts_with(path, '/parts/')"
ORACLE["usage_everything"] = f"{ENTRIES} SELECT '' AS path, {_totals()} FROM entries WHERE NOT is_dir"


def _children(scope: str, filt: str = "true", top: int = 20) -> str:
    n = len(scope) + 2
    rest = f"substr(parent, {n})"
    return f"""{ENTRIES}, below AS (SELECT *, '{scope}/' || string_split({rest}, '/')[1] AS child FROM entries WHERE NOT is_dir AND starts_with(parent, '{scope}/') AND {rest} <> '' AND ({filt}))
      SELECT child AS path, {_totals()}, CAST(count(*) OVER () AS BIGINT) AS child_count FROM below GROUP BY child ORDER BY bytes DESC, path LIMIT {top}"""


ORACLE["usage_children"] = _children("/parts")
ORACLE["usage_top"] = _children("", top=3)
ORACLE["usage_filtered"] = _children("/corpus", "size > 1500", top=5)
ORACLE["subtree_sizes"] = f"""{ENTRIES}, up AS (SELECT *, unnest(range(2, len(string_split(path, '/')))) AS i FROM entries WHERE NOT is_dir)
  SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, {_totals()} FROM up GROUP BY ALL"""
ORACLE["folder_weight"] = f"""{ENTRIES}, up AS (SELECT *, unnest(range(2, len(string_split(path, '/')))) AS i FROM entries WHERE NOT is_dir),
  sizes AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, CAST(sum(disk // links) AS BIGINT) AS d, count(*) AS n FROM up GROUP BY ALL)
  SELECT e.source, e.path, CASE WHEN is_dir THEN coalesce(d, 0) END AS under_disk, CASE WHEN is_dir THEN coalesce(n, 0) END AS under_files FROM entries e LEFT JOIN sizes s ON s.path = e.path"""
ORACLE["sort_size_rollup"] = f"""{ENTRIES}, up AS (SELECT *, unnest(range(2, len(string_split(path, '/')))) AS i FROM entries WHERE NOT is_dir),
  sizes AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, CAST(sum(disk // links) AS BIGINT) AS d FROM up GROUP BY ALL)
  SELECT CAST(row_number() OVER (ORDER BY CASE WHEN is_dir THEN coalesce(d, 0) ELSE e.size END DESC, mtime DESC, e.path) AS INT) AS rank, e.path FROM entries e LEFT JOIN sizes s ON s.path = e.path
  WHERE contains(bare, 'bolt') OR is_dir QUALIFY rank <= 60"""
ORACLE["children_count"] = f"{ENTRIES} SELECT parent, count(*) AS children FROM entries GROUP BY parent"
ORACLE["dir_tree"] = f"""{ENTRIES}, kids AS (SELECT parent AS path, count(*) AS n FROM entries GROUP BY parent),
  placed AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY bare, path) AS place FROM entries WHERE starts_with(path, '/parts/') AND depth <= 3 QUALIFY place <= 4),
  one AS (SELECT * FROM placed WHERE depth = 2), two AS (SELECT * FROM placed WHERE depth = 3 AND parent IN (SELECT path FROM one WHERE is_dir))
  SELECT t.path, CAST(depth - 1 AS INT) AS level, is_dir, CASE WHEN is_dir THEN coalesce(n, 0) END AS children, coalesce(is_dir AND n > 4, false) AS truncated
  FROM (SELECT * FROM one UNION ALL SELECT * FROM two) t LEFT JOIN kids ON kids.path = t.path"""

ORACLE["dupes_size"] = f"""{ENTRIES} SELECT size, count(*) AS files, min(path) AS first_path, size * (count(*) - 1) AS waste FROM entries WHERE NOT is_dir AND size >= 1000 GROUP BY size HAVING count(*) > 1
  ORDER BY waste DESC, size DESC, first_path LIMIT 50"""
_DUP = f"""{CONTENTS}, cand AS (SELECT e.source, e.path, size, sha256(content) AS digest FROM entries e JOIN contents c ON c.source = e.source AND c.path = e.path WHERE size >= 200),
  grp AS (SELECT digest, size, count(*) AS files, min(path) AS first_path, size * (count(*) - 1) AS waste FROM cand GROUP BY digest, size HAVING count(*) > 1)"""
ORACLE["dupes_content"] = f"{_DUP} SELECT digest, size, files, first_path, waste FROM grp ORDER BY waste DESC, size DESC, first_path LIMIT 50"
ORACLE["dupes_members"] = f"{_DUP} SELECT digest, source, path FROM cand WHERE digest IN (SELECT digest FROM grp)"
ORACLE["dupes_report"] = f"""{_DUP}, own AS (SELECT * FROM entries WHERE NOT is_dir AND size >= 200 AND source IN (0, 1, 4)),
  bysize AS (SELECT size * (count(*) - 1) AS waste FROM own GROUP BY size HAVING count(*) > 1)
  SELECT (SELECT count(*) FROM own) AS candidates, (SELECT CAST(sum(waste) AS BIGINT) FROM bysize) AS waste, (SELECT count(*) FROM bysize) AS size_groups,
    (SELECT CAST(coalesce(sum(waste), 0) AS BIGINT) FROM grp) AS proven, (SELECT count(*) FROM grp) AS content_groups"""


def _hits(pattern: str, filt: str = "true", top: int = 50) -> str:
    return f"""{CONTENTS}, l AS (SELECT e.source, e.path, mtime, content, string_split(content, chr(10)) AS lines FROM contents c JOIN entries e ON e.source = c.source AND e.path = c.path
      WHERE size > 0 AND ({filt}) AND regexp_matches(content, '{pattern}')),
      n AS (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l), h AS (SELECT *, row_number() OVER (PARTITION BY source, path ORDER BY i) AS k, count(*) OVER (PARTITION BY source, path) AS c FROM n WHERE regexp_matches(lines[i], '{pattern}'))
      SELECT source, path, CAST(i AS INT) AS line, CAST(strlen(array_to_string(lines[1:i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END + strlen(substr(lines[i], 1, instr(lines[i], regexp_extract(lines[i], '{pattern}')) - 1)) AS BIGINT) AS "offset",
        CAST(length(regexp_extract(lines[i], '{pattern}')) AS INT) AS length, c > 3 AS more FROM h WHERE k <= 3 QUALIFY dense_rank() OVER (ORDER BY mtime DESC, path) <= {top}"""


ORACLE["grep_text"] = _hits("[lL][iIİı][cC][eE][nN][sS][eE]")
ORACLE["grep_regex"] = _hits("(?i)token = .[0-9a-f]+", top=1000)
ORACLE["grep_outcomes"] = f"""{CONTENTS} SELECT CASE WHEN strlen(content) = 0 THEN 'clean' WHEN strlen(content) > 67108864 THEN 'too_big' WHEN contains(substr(content, 1, 8192), chr(0)) THEN 'binary' ELSE 'read' END AS outcome,
  count(*) AS files FROM contents GROUP BY ALL"""
ORACLE["grep_hex"] = _hits("token =", top=1000)
ORACLE["grep_in_query"] = _hits("[tT][hH][eE] [aA]", "e.source = 4", top=20)
ORACLE["content_and_query"] = f"""{CONTENTS} SELECT e.source, e.path FROM entries e JOIN contents c ON c.source = e.source AND c.path = e.path
  WHERE NOT is_dir AND ext = 'txt' AND regexp_matches(content, '[tT][hH][eE] ') AND regexp_matches(content, '[lL][iIİı][cC][eE][nN][sS][eE]')"""

_PART = "lower(path) || '/'"
ORACLE["rules_exclude"] = f"""{ENTRIES} SELECT source, path FROM entries WHERE NOT (path = '/orders/F' OR starts_with(path, '/orders/F/') OR contains('/' || lower(CASE WHEN is_dir THEN path ELSE parent END) || '/', '/small/')
  OR contains(lower(CASE WHEN is_dir THEN path ELSE parent END) || '/', '/brand2/promo/') OR (NOT is_dir AND lower(name) = '.rs'))"""
ORACLE["rules_allow"] = f"""{ENTRIES} SELECT source, path FROM entries WHERE NOT (starts_with(path, '/chats/c1/') OR path = '/chats/c1' OR (
  NOT (path = '/parts/Brand1/SMALL' OR starts_with(path, '/parts/Brand1/SMALL/') OR (lower(CASE WHEN is_dir THEN path ELSE parent END) LIKE '%/brand3/small')) AND contains(lower(CASE WHEN is_dir THEN path ELSE parent END) || '/', '/small/')))"""
ORACLE["rules_gone"] = f"""{ENTRIES}, gone AS (SELECT DISTINCT path FROM entries WHERE contains(lower(CASE WHEN is_dir THEN path ELSE parent END) || '/', '/small/'))
  SELECT path FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone o WHERE starts_with(g.path, o.path || '/'))"""
ORACLE["prefix_reduce"] = f"""{ENTRIES}, own AS (SELECT DISTINCT path FROM entries WHERE is_dir AND contains(bare, '1'))
  SELECT path FROM own g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE starts_with(g.path, o.path || '/'))"""
ORACLE["owner_of_path"] = f"""{ENTRIES}, roots AS (SELECT * FROM (VALUES (1, '/parts'), (2, '/parts/Brand1'), (3, '/orders'), (4, '/parts/Brand1/SMALL')) t(s, root))
  SELECT path, arg_max(s, length(root)) AS source FROM (SELECT DISTINCT path FROM entries) LEFT JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path"""

_OLD = "SELECT source, path, is_dir, size, mtime, ctime, mode, uid, gid, atime FROM entries WHERE length(path) % 7 <> 0"
_NEW = "SELECT source, path, is_dir, CASE WHEN length(path) % 3 = 0 AND NOT is_dir THEN size + 1 ELSE size END AS size, mtime, ctime, mode, uid, gid, atime + 5 AS atime FROM entries WHERE length(path) % 5 <> 0 AND source <> 2"
ORACLE["reconcile_states"] = f"""{ENTRIES}, o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.source, n.source) AS source, coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NOT NULL AND o.size = n.size THEN 'unchanged' WHEN n.path IS NOT NULL THEN 'changed'
    WHEN o.source <> 2 AND NOT (o.path = '/parts/Brand1' OR starts_with(o.path, '/parts/Brand1/')) AND (o.path = '/parts' OR starts_with(o.path, '/parts/') OR o.path = '/corpus' OR starts_with(o.path, '/corpus/')) THEN 'gone' ELSE 'spared' END AS state
  FROM o FULL JOIN n ON o.source = n.source AND o.path = n.path"""
ORACLE["reconcile_table"] = f"""WITH s AS ({ORACLE["reconcile_states"]}), {ENTRIES[5:]}, o AS ({_OLD}), n AS ({_NEW}) SELECT o.source, o.path, o.size FROM o JOIN s USING (source, path) WHERE state IN ('unchanged', 'spared')
  UNION ALL SELECT n.source, n.path, n.size FROM n JOIN s USING (source, path) WHERE state IN ('new', 'changed')"""

#: Changes told by the events: purchases, signups and clicks write a file, errors remove its folder.
FEED = """WITH feed AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'remove_subtree' WHEN 'view' THEN 'rescan' ELSE 'upsert' END AS op, '/feed/u' || user_id % 40 AS folder,
  '/feed/u' || user_id % 40 || '/f' || user_id % 7 || '.dat' AS path, CAST(floor(value * 100) AS BIGINT) AS size FROM events),
start AS (SELECT DISTINCT path, folder FROM feed WHERE seq % 3 = 0),
ups AS (SELECT path, folder, max(seq) AS seq, arg_max(size, seq) AS size FROM feed WHERE op = 'upsert' AND seq % 5 <> 0 GROUP BY ALL),
rms AS (SELECT folder, max(seq) AS seq FROM feed WHERE op = 'remove_subtree' AND seq % 5 <> 0 AND folder NOT LIKE '%1' GROUP BY ALL),
live AS (SELECT ups.path, ups.size FROM ups LEFT JOIN rms USING (folder) WHERE rms.seq IS NULL OR rms.seq < ups.seq)
"""
ORACLE["event_translation"] = """WITH e AS (SELECT event_id AS seq, CASE WHEN user_id % 97 = 0 OR event_type = 'view' THEN ['rescan'] WHEN event_type = 'error' THEN ['remove_subtree'] WHEN event_type = 'signup' THEN ['upsert', 'rescan'] ELSE ['upsert'] END AS ops,
    CASE WHEN user_id % 194 <> 0 THEN '/u' || user_id ELSE '' END AS path, CAST(floor(value * 100) AS BIGINT) AS size FROM events), o AS (SELECT *, unnest(ops) AS op FROM e)
  SELECT seq, op, path, CASE WHEN op = 'upsert' THEN size END AS size FROM o"""
ORACLE["upsert_latest"] = f"{FEED} SELECT path, size FROM live"
ORACLE["apply_changes"] = f"{FEED} SELECT path, size FROM live UNION ALL SELECT path, CAST(-1 AS BIGINT) FROM start WHERE path NOT IN (SELECT path FROM live) AND folder NOT IN (SELECT folder FROM rms)"
ORACLE["stream_upsert"] = ORACLE["apply_changes"]
ORACLE["apply_report"] = f"""{FEED} SELECT (SELECT count(*) FROM live) AS upserted, (SELECT count(*) FROM live JOIN start USING (path) WHERE size = -1) AS unchanged, (SELECT count(*) FROM rms) AS subtrees_removed,
  (SELECT count(*) FROM start WHERE folder IN (SELECT folder FROM rms)) AS rows_removed"""
ORACLE["debounce"] = """WITH r AS (SELECT CAST(user_id % 3 AS INT) AS source, CAST(event_id * 130 + user_id % 400 AS BIGINT) AS at_ms, CASE WHEN user_id % 97 = 0 THEN '' WHEN user_id % 2 = 0 THEN '/a/u' || user_id % 9 ELSE '/a/u' || user_id % 9 || '/x' END AS path
    FROM events WHERE event_type = 'view'),
  g AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY source ORDER BY at_ms, path) > 500 THEN 1 ELSE 0 END AS gap FROM r),
  b AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY source ORDER BY at_ms, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM g),
  s AS (SELECT *, min(at_ms) OVER (PARTITION BY source, burst) AS begin_ms, (at_ms - min(at_ms) OVER (PARTITION BY source, burst)) // 3000 AS slice FROM b),
  a AS (SELECT source, burst, slice, list(DISTINCT path) AS ps, max(at_ms) AS last, min(begin_ms) AS begin_ms FROM s GROUP BY ALL)
  SELECT source, burst, CASE WHEN list_contains(ps, '') THEN last ELSE least(last + 500, begin_ms + (slice + 1) * 3000) END AS run_at,
    CASE WHEN list_contains(ps, '') THEN '' ELSE array_to_string(list_sort(list_filter(ps, lambda p: len(list_filter(ps, lambda q: starts_with(p, q || '/'))) = 0)), ' ') END AS paths FROM a"""

_VALUES = f"""{ENTRIES}, v AS (SELECT kind AS idx, count(*) AS value FROM entries GROUP BY kind), t AS (SELECT sum(value) AS t FROM v)"""


def _lrm(whole: int, shown: str) -> str:
    return f"""{_VALUES}, u AS (SELECT idx, value, CAST(value * {whole} // t AS BIGINT) AS units, value * {whole} % t AS rem FROM v, t),
      p AS (SELECT *, row_number() OVER (ORDER BY rem DESC, idx) AS place, {whole} - sum(units) OVER () AS short FROM u)
      SELECT idx, value, {shown} FROM p"""


ORACLE["shares_lrm"] = _lrm(1000, "(units + CASE WHEN place <= short THEN 1 ELSE 0 END) / 10.0 AS share").replace("/ 10.0", "/ CAST(10 AS DOUBLE)")
ORACLE["bar_cells"] = _lrm(40, "CAST(units + CASE WHEN place <= short THEN 1 ELSE 0 END AS BIGINT) AS cells")
ORACLE["fold_rest"] = f"""{_VALUES}, p AS (SELECT *, row_number() OVER (ORDER BY value DESC, idx) AS place FROM v)
  SELECT CAST(least(place, 5) AS INT) AS place, max(CASE WHEN place <= 4 THEN idx END) AS idx, count(*) AS count, CAST(sum(value) AS BIGINT) AS value FROM p GROUP BY least(place, 5)"""
_SEG = "round(coalesce(sum(value) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(t AS DOUBLE) * {n}, 6) AS start, round(value / CAST(t AS DOUBLE) * {n}, 6) AS width"
ORACLE["bar_segments"] = f"{_VALUES} SELECT idx, value, {_SEG.format(n=1.0)} FROM v, t"
ORACLE["ring_arcs"] = f"{_VALUES} SELECT idx, value, {_SEG.format(n=360.0)} FROM v, t"
