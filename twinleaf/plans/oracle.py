"""DuckDB SQL that says what the catalogue's queries return, each written out on its own terms."""

from __future__ import annotations

THRESHOLD, CHAT_THRESHOLD = 10, 4
_EXCLUDED = ("https://spam-farm.example.org", "http://blog.ththan.example.net/en", "https://ththin.example.com/en/671")
# What each flag takes away, in this order, and the private-use character put there.
PASSES = (
    ("identifiers", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|https?://[^ ]+", chr(0xe001)),
    ("literals", r"[0-9]+", chr(0xe002)),
    ("names", r"\p{Lu}\p{L}*", chr(0xe003)),
    ("variables", r"\p{Ll}\p{L}*", chr(0xe004)),
)
#: The flags of each query anon_*.
FLAGS = {**{flag: {flag} for flag, _, _ in PASSES}, "all": {flag for flag, _, _ in PASSES}}
_WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_DIGITS = next(p for p in PASSES if p[0] == "literals")


def _norm(text: str, flags: str | None) -> str:
    if flags is None:
        return f"lower(regexp_replace({text}, '{_DIGITS[1]}', '{_DIGITS[2]}', 'g'))"
    for flag, pattern, mark in PASSES:
        if flag in FLAGS[flags]:
            text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS file, CAST(doc_id AS BIGINT) AS file_ord, text FROM documents"
_CHATS = "SELECT CAST(conv_id AS VARCHAR) AS file, CAST(conv_id AS BIGINT) AS file_ord, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id"


def _nodes(files: str = _DOCS, flags: str | None = None, least: int = THRESHOLD, name: str = "nodes") -> str:
    """CTEs up to {name}(file, file_ord, post_ord, start_line, end_line, node_count, hash)."""
    p = name
    return f"""{p}_f AS ({files}),
{p}_l AS (SELECT file, file_ord, text, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM {p}_f WHERE text IS NOT NULL),
{p}_w AS (SELECT *, len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS words FROM {p}_l WHERE trim(t, {_WHITE}) <> ''),
{p}_d AS (SELECT f.file, f.file_ord, f.text, len(string_split(f.text, chr(10))) AS n, 1 + count(w.ln) + coalesce(sum(w.words), 0) AS total
  FROM {p}_f f LEFT JOIN {p}_w w ON w.file = f.file WHERE f.text IS NOT NULL GROUP BY 1, 2, 3),
{p} AS (SELECT * FROM (
  SELECT file, file_ord, CAST(ln AS BIGINT) AS post_ord, CAST(ln AS BIGINT) AS start_line, CAST(ln AS BIGINT) AS end_line, CAST(words + 1 AS BIGINT) AS node_count, md5('L|' || {_norm("t", flags)}) AS hash FROM {p}_w
  UNION ALL SELECT file, file_ord, CAST(n + 1 AS BIGINT), 1, CAST(n AS BIGINT), CAST(total AS BIGINT), md5('D|' || {_norm("text", flags)}) FROM {p}_d)
  WHERE node_count >= {least})"""


_INST = """groups AS (SELECT hash, count(*) AS instance_count, arg_min(node_count, file_ord * 10000000 + post_ord) AS group_nodes, min(file_ord * 10000000 + post_ord) AS first FROM nodes GROUP BY hash HAVING count(*) >= 2),
inst AS (SELECT n.*, g.group_nodes FROM nodes n JOIN groups g USING (hash))"""
_CHANGED = f"""changed AS (SELECT CAST(doc_id AS VARCHAR) AS file, CAST(ln AS BIGINT) AS line FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL) WHERE doc_id % 5 = 0 OR (doc_id % 7 = 0 AND ln % 2 = 0))"""
_TOUCHED = """touched AS (SELECT i.*, (SELECT count(*) FROM changed c WHERE c.file = i.file AND c.line BETWEEN i.start_line AND i.end_line) = i.end_line - i.start_line + 1 AS changed FROM inst i)"""
_COVERED = """covered AS (SELECT i.*, EXISTS (SELECT 1 FROM {inst} b WHERE b.file = i.file AND b.group_nodes > i.group_nodes AND b.start_line <= i.start_line AND b.end_line >= i.end_line) AS covered FROM {inst} i)"""
_KEPT = "kept AS (SELECT * FROM {inst} WHERE hash IN (SELECT hash FROM covered GROUP BY hash HAVING NOT bool_and(covered)))"


def _summary(inst: str, extra: str = "") -> str:
    return f"SELECT hash, CAST(arg_min(node_count, file_ord * 10000000 + post_ord) AS BIGINT) AS node_count, count(*) AS instance_count{extra} FROM {inst} GROUP BY hash"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


# all instances, their lines with tabs expanded, and the lines dedented
_LEAD = f"CASE WHEN trim(t, {_WHITE}) <> '' THEN regexp_extract(t, '^[ \\t]*') END"


def _dedent(source: str, key: str) -> str:
    return f"""lead AS (SELECT {key}, min({_LEAD}) AS a, max({_LEAD}) AS b FROM {source} GROUP BY {key}),
prefix AS (SELECT {key}, coalesce(a[1:coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])), 0)], '') AS pre FROM lead),
dedented AS (SELECT s.* EXCLUDE (t), CASE WHEN starts_with(t, pre) THEN substr(t, length(pre) + 1) ELSE '' END AS t FROM {source} s JOIN prefix USING ({key}))"""


_REPORT = [
    _nodes(),
    "docs AS (SELECT * FROM nodes)",
    "several AS (SELECT hash FROM docs GROUP BY hash HAVING count(*) >= 2)",
    "numbered AS (SELECT d.*, row_number() OVER (PARTITION BY hash ORDER BY file_ord, post_ord) - 1 AS inst FROM docs d WHERE hash IN (FROM several))",
    "raw AS (SELECT n.hash, n.inst, n.file, l.ln AS line, replace(l.t, chr(9), '    ') AS t FROM numbered n JOIN nodes_l l ON l.file = n.file AND l.ln BETWEEN n.start_line AND n.end_line)",
    _dedent("raw", "hash, inst"),
]
_COUNTED = [
    f"counted AS (SELECT *, CASE WHEN trim(t, {_WHITE}) <> '' THEN sum(CASE WHEN trim(t, {_WHITE}) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY hash, inst ORDER BY line) END AS idx FROM dedented)",
    "sizes AS (SELECT hash, inst, count(idx) AS n FROM counted GROUP BY 1, 2)",
    "unifiable AS (SELECT hash FROM sizes GROUP BY hash HAVING min(n) = max(n))",
]
_CONTENT = [*_REPORT, *_COUNTED]
_SAME_START = [
    "docs AS (SELECT doc_id, text, md5(split_part(text, chr(10), 1)) AS hash FROM documents WHERE text IS NOT NULL)",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) - 1 AS inst FROM docs WHERE hash IN (SELECT hash FROM docs GROUP BY hash HAVING count(*) >= 2))",
    "raw AS (SELECT hash, inst, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM numbered)",
    "tabless AS (SELECT hash, inst, line, replace(x, chr(9), '    ') AS t FROM raw)",
    _dedent("tabless", "hash, inst"),
    *_COUNTED,
]


def statements() -> dict[str, str]:
    found = {
        "doc_lines": f"""SELECT doc_id, CAST(ln AS BIGINT) AS line, CAST(CASE WHEN trim(t, {_WHITE}) <> '' THEN sum(CASE WHEN trim(t, {_WHITE}) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) END AS BIGINT) AS content_no, md5(t) AS line_md5
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text <> '')""",
        "doc_subtrees": _with(_nodes(least=1), "SELECT file, post_ord, start_line, end_line, node_count, hash FROM nodes"),
        "hash_groups": _with(_nodes(), _INST, "SELECT hash, group_nodes AS node_count, instance_count, first // 10000000 AS first_file, first % 10000000 AS first_node FROM groups"),
        "clone_instances": _with(_nodes(), _INST, "SELECT hash, file, post_ord, start_line, end_line, group_nodes FROM inst"),
        "changed_lines": _with(_CHANGED, "SELECT file, line FROM changed"),
        "patch_contains_range": _with(_nodes(), _INST, _CHANGED, _TOUCHED, "SELECT hash, file, post_ord, changed FROM touched"),
        "patch_filter": _with(_nodes(), _INST, _CHANGED, _TOUCHED, "patched AS (SELECT * FROM inst WHERE hash IN (SELECT hash FROM touched WHERE changed))", _summary("patched")),
        "patch_new_vs_existing": _with(_nodes(), _INST, _CHANGED, _TOUCHED, "SELECT hash, count(*) FILTER (changed) AS new, count(*) FILTER (NOT changed) AS existing, bool_and(changed) AS intra_patch FROM touched GROUP BY hash HAVING bool_or(changed)"),
        "subsumption_covered": _with(_nodes(), _INST, _COVERED.format(inst="inst"), "SELECT hash, file, post_ord, covered FROM covered"),
        "subsumption_filter": _with(_nodes(), _INST, _COVERED.format(inst="inst"), _KEPT.format(inst="inst"), "SELECT hash, file, post_ord FROM kept"),
        "clone_groups": _with(_nodes(), _INST, _COVERED.format(inst="inst"), _KEPT.format(inst="inst"), _summary("kept")),
        "clone_groups_patch": _with(_nodes(), _INST, _CHANGED, _TOUCHED, "patched AS (SELECT * FROM inst WHERE hash IN (SELECT hash FROM touched WHERE changed))", _COVERED.format(inst="patched"), _KEPT.format(inst="patched"), _summary("kept")),
        "clone_groups_ranked": _with(_nodes(), _INST, _COVERED.format(inst="inst"), _KEPT.format(inst="inst"), f"g AS ({_summary('kept', ', min(file_ord * 10000000 + post_ord) AS first')})", "SELECT row_number() OVER (ORDER BY node_count DESC, instance_count DESC, first) AS clone_no, hash, node_count, instance_count FROM g"),
        "exclude_filter": "SELECT page_id, url FROM pages WHERE " + " AND ".join(f"NOT (url = '{e}' OR starts_with(url, '{e}/'))" for e in _EXCLUDED),
        "scan_dedup": "SELECT url AS path, min(page_id) AS first_page FROM pages GROUP BY url",
        "exact_match": _with(*_REPORT, "bodies AS (SELECT hash, inst, string_agg(t, chr(10) ORDER BY line) AS body FROM dedented GROUP BY 1, 2)", "SELECT hash, count(DISTINCT body) = 1 AS exact FROM bodies GROUP BY hash"),
        "dedent_lines": _with(
            "raw AS (SELECT CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text <> '')",
            "tabless AS (SELECT file, line, replace(x, chr(9), '    ') AS t FROM raw)",
            _dedent("tabless", "file"),
            "SELECT file, CAST(line AS BIGINT) AS line, md5(t) AS text_md5 FROM dedented",
        ),
        "unified_rows": _with(
            *_CONTENT,
            f"full_lines AS (SELECT *, trim(t, {_WHITE}) AS key FROM counted WHERE idx IS NOT NULL AND hash IN (FROM unifiable))",
            "texts AS (SELECT hash, idx, key, min(inst) AS inst0, arg_min(t, inst) AS text, string_agg(CAST(line AS VARCHAR), ', ' ORDER BY inst) AS all_lines FROM full_lines GROUP BY 1, 2, 3)",
            "places AS (SELECT hash, idx, count(DISTINCT key) AS kinds, min(CASE WHEN inst = 0 THEN line END) AS line0 FROM full_lines GROUP BY 1, 2)",
            f"""SELECT hash, CAST(line0 AS BIGINT) AS line0, CAST(row_number() OVER (PARTITION BY hash, idx ORDER BY inst0) - 1 AS BIGINT) AS variant, CASE WHEN kinds > 1 THEN all_lines ELSE CAST(line0 AS VARCHAR) END AS labels, text, inst0 > 0 AS alternative
FROM texts JOIN places USING (hash, idx)
UNION ALL SELECT hash, CAST(line AS BIGINT), 0, CAST(line AS VARCHAR), '', false FROM counted WHERE inst = 0 AND idx IS NULL AND hash IN (FROM unifiable)""",
        ),
        "unified_fallback": _with(*_SAME_START, "SELECT hash, CAST(inst AS BIGINT) AS inst, CAST(line AS BIGINT) AS line, t AS text FROM counted WHERE hash NOT IN (FROM unifiable)"),
        "line_label_width": _with(_nodes(), _INST, "SELECT hash, CAST(greatest(3, length(CAST(max(end_line) AS VARCHAR))) AS BIGINT) AS width FROM inst GROUP BY hash"),
        "cache_hit_miss": _with(_nodes(), "hits AS (SELECT DISTINCT md5(text) AS m FROM documents WHERE doc_id % 3 = 0)", "SELECT n.file, md5(f.text) IN (FROM hits) AS hit, count(*) AS subtrees FROM nodes n JOIN nodes_f f USING (file) GROUP BY 1, 2"),
        "chat_clone_groups": _with(_nodes(_CHATS, least=CHAT_THRESHOLD), _INST, _COVERED.format(inst="inst"), _KEPT.format(inst="inst"), _summary("kept")),
        "benchmark_overlap": _with(
            _nodes("SELECT CAST(item_id AS VARCHAR) AS file, CAST(item_id AS BIGINT) AS file_ord, text FROM benchmark", least=1, name="bench"),
            _nodes(least=1),
            "SELECT file_ord AS doc_id, count(*) AS lines, CAST(sum(node_count) AS BIGINT) AS nodes FROM nodes WHERE hash IN (SELECT hash FROM bench WHERE start_line = end_line AND node_count >= 1) GROUP BY 1",
        ),
    }
    for name in FLAGS:
        found[f"anon_{name}"] = _with(_nodes(flags=name), _INST, _summary("inst"))
    for n in (5, 10, 50):
        found[f"min_node_count_filter_{n}"] = _with(_nodes(least=n), "SELECT file, count(*) AS subtrees, CAST(sum(node_count) AS BIGINT) AS nodes FROM nodes GROUP BY file")
    return found
