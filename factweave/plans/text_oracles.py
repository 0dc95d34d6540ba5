"""DuckDB SQL for the text operators, written for RE2 and apart from the operators' own code."""

from __future__ import annotations

from factweave.functions import patterns as P

from .views import ctes

#: RE2's words are ASCII: letters outside it become `_`, other such characters a space, which gives the same matches.
PLAIN = r"regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The JVM's flags in RE2: Unicode and line-end flags go, the rest stay."""
    head = pattern[: pattern.index(")") + 1] if pattern.startswith("(?") and pattern[2] in "Uimds" else ""
    flags = "".join(f for f in head[2:-1] if f in "ims")
    return q((f"(?{flags})" if flags else "") + pattern[len(head) :])


def chunks(source: str) -> str:
    """CTEs that end in `o_chunks` over a table with doc_id and text."""
    strip = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
    n = lambda p, g=0: f"len(regexp_extract_all(content, {re2(p)}, {g}))"
    has = lambda p: f"regexp_matches(content, {re2(p)})"
    return rf"""
    o_docs AS (SELECT doc_id, coalesce(text, '') AS text, substr({strip.format("coalesce(text, '')")}, 1, 1) AS head FROM {source}),
    o_kind AS (SELECT *, CASE WHEN head IN ('{{', '[') THEN 'JSON' WHEN head = '<' AND contains(lower(text), 'xbrl') THEN 'XBRL' WHEN head = '<' THEN 'XML' ELSE 'TEXT' END AS kind FROM o_docs),
    o_split AS (SELECT doc_id, kind, text, CASE WHEN kind = 'TEXT' THEN string_split_regex(text, '\n\s*\n') ELSE [text] END AS parts FROM o_kind),
    o_parts AS (SELECT doc_id, kind, text, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM o_split),
    o_full AS (SELECT doc_id, kind, text, pos, {strip.format('raw')} AS content FROM o_parts WHERE {strip.format('raw')} <> ''),
    o_seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_seq FROM o_full),
    o_sect AS (SELECT *, last_value(CASE WHEN kind = 'TEXT' AND length(content) <= 100 AND right(content, 1) NOT IN ('.', ',', ';', ':') AND ({has(P.SECTION_MARKDOWN)} OR {has(P.SECTION_CAPS)} OR {has(P.SECTION_NAMED)}) THEN lower(content) END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY chunk_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM o_seq),
    o_count AS (SELECT *, len(regexp_extract_all(content, '\S+')) AS words, {n(P.MONEY)} AS n_money, {n(P.PERCENT)} AS n_percent, {n(P.DATE)} AS n_dates, {n(P.KEY_VALUE)} AS n_kv,
        {n(P.BULLET)} + {n(P.NUMBERED)} AS n_list, ({has(P.TABLE_PIPE)} OR {has(P.TABLE_TAB)}) AND ({has(P.TABLE_SEPARATOR)} OR {has(P.TABLE_TAB)}) AS has_table, {has(P.CODE_FENCE)} AS has_code, {has(P.CITATION)} AS has_cite FROM o_sect),
    o_typed AS (SELECT *, CASE WHEN kind <> 'TEXT' THEN kind WHEN coalesce(contains(section, 'reference'), false) AND (has_cite OR n_list > 0) THEN 'CITATION' WHEN has_table THEN 'TABLE' WHEN has_code THEN 'CODE'
        WHEN n_kv * 10 > words THEN 'KEY_VALUE' WHEN n_list * 5 > words THEN 'LIST' WHEN n_money + n_percent + n_dates > 0 AND words < 20 THEN 'METADATA' ELSE 'PROSE' END AS chunk_type FROM o_count),
    o_chunks AS (SELECT doc_id, chunk_seq, printf('chunk_%06d', chunk_seq) AS chunk_id, chunk_type,
        CASE chunk_type WHEN 'CITATION' THEN 1 WHEN 'KEY_VALUE' THEN 1 WHEN 'LIST' THEN 1 WHEN 'METADATA' THEN 1 WHEN 'PROSE' THEN CASE WHEN words < 200 THEN 3 ELSE 4 END ELSE 0 END AS tier,
        content, section, words, substr(sha256(content), 1, 16) AS content_hash, strpos(text, content) - 1 AS first_start, lower(content) AS low FROM o_typed)"""


def _each(select: str, where: str = "chunk_type NOT IN ('JSON', 'XML', 'XBRL')", lists: str = "") -> str:
    """Rows of the matches of one extractor: `m` is the match and `pos` its place."""
    return f"SELECT doc_id, chunk_id, chunk_seq, pos, {select} FROM (SELECT doc_id, chunk_id, chunk_seq, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, chunk_id, chunk_seq, {lists} AS l FROM o_chunks WHERE {where}) WHERE len(l) > 0)"


def _row(kind: str, label: str, coord: tuple, value_kind: str = "'null'", value_str: str = "NULL", value_num: str = "NULL", unit: str = "NULL") -> str:
    return f"'{kind}' AS entity_type, {label} AS label, {coord[0]} AS major, {coord[1]} AS type, {coord[2]} AS subtype, {value_kind} AS value_kind, cast({value_str} AS VARCHAR) AS value_str, cast({value_num} AS DOUBLE) AS value_num, cast({unit} AS VARCHAR) AS unit"


_MONEY = r"""(CASE WHEN contains(lower(m), 'billion') OR ends_with(m, 'B') THEN 1e9 WHEN contains(lower(m), 'million') OR ends_with(m, 'M') THEN 1e6 WHEN ends_with(m, 'K') THEN 1e3 ELSE 1.0 END
   * try_cast(trim(CASE WHEN contains(lower(m), 'billion') OR ends_with(m, 'B') THEN regexp_replace(translate(m, '$,', ''), '(?i)billion|B$', '') WHEN contains(lower(m), 'million') OR ends_with(m, 'M') THEN regexp_replace(translate(m, '$,', ''), '(?i)million|M$', '')
   WHEN ends_with(m, 'K') THEN regexp_replace(translate(m, '$,', ''), 'K$', '') ELSE translate(m, '$,', '') END) AS DOUBLE))"""
_num = lambda v: ("CASE WHEN " + v + " IS NULL THEN 'null' ELSE 'float' END", f"cast({v} AS VARCHAR)", v)
_PROSE = "chunk_type = 'PROSE'"
_all = lambda p, g=0: f"regexp_extract_all(content, {re2(p)}, {g})"


def _distinct(patterns: tuple, most: int, least: int = 0) -> str:
    both = f"({' || '.join(_all(p, 1) for p in patterns)})"
    first = f"list_filter({both}, lambda x, i: list_position({both}, x) = i)"
    return f"list_slice(list_filter({first}, lambda x: length(x) > {least}), 1, {most})"


def _claims() -> str:
    clear = lambda i: f"NOT regexp_matches(substr(low, greatest({i} - 20, 1), least({i} - 1, 20)), {re2(P.NEGATION)})"
    hits = lambda words: " + ".join(f"CASE WHEN contains(low, {q(w)}) THEN len(list_filter(range(1, greatest(length(low) - {len(w)} + 2, 1)), lambda i: substr(low, i, {len(w)}) = {q(w)} AND {clear('i')})) ELSE 0 END" for w in words)
    rows = []
    for pos, (name, words) in enumerate(P.CLAIM_WORDS.items()):
        other = {"GROWTH": "DECLINE", "DECLINE": "GROWTH"}.get(name, name)
        label = f"CASE WHEN regexp_matches(low, {re2(P.NEGATION)}) THEN '{other} claim' ELSE '{name} claim' END"
        rows.append(f"SELECT doc_id, chunk_id, chunk_seq, {pos} AS pos, {label} AS label, least(1.0, ({hits(words)}) * 0.25)::DOUBLE AS v FROM o_chunks WHERE chunk_type <> 'JSON'")
    return f"SELECT doc_id, chunk_id, chunk_seq, pos, {_row('ClaimType', 'label', (8, 1, 2), *_num('v'))} FROM ({' UNION ALL '.join(rows)}) WHERE v > 0"


def _sentiment() -> str:
    score = {n: "(" + " + ".join(f"contains(low, {q(w)})::INT" for w in ws) + ")" for n, ws in P.SENTIMENT_WORDS.items()}
    top = f"greatest({', '.join(score.values())})"
    label = "CASE " + " ".join(f"WHEN {s} = top THEN '{n} sentiment'" for n, s in score.items()) + " END"
    return f"SELECT doc_id, chunk_id, chunk_seq, 0 AS pos, {_row('Sentiment', label, (8, 2, 1), chr(39) + 'int' + chr(39), 'top', 'top')} FROM (SELECT *, {top} AS top FROM o_chunks WHERE chunk_type <> 'JSON') WHERE top > 0"


_KV = f"list_zip({_all(P.KEY_VALUE, 1)}, {_all(P.KEY_VALUE, 2)})"
EXTRACTORS: dict[str, str] = {
    "money": _each(_row("Money", "m", (7, 1, 1), *_num(_MONEY), "'USD'"), lists=_all(P.MONEY)),
    "percent": _each(_row("Percentage", "m", (7, 2, 1), *_num("try_cast(trim(replace(m, '%', '')) AS DOUBLE)"), "'%'"), lists=f"list_filter({_all(P.PERCENT)}, lambda x: try_cast(trim(replace(x, '%', '')) AS DOUBLE) IS NOT NULL)"),
    "dates": _each(_row("Date", "m", (6, 1, 1), "'str'", "m"), lists=_all(P.DATE)),
    "kv": _each(_row("KeyValue", "trim(m[1]) || ': ' || trim(m[2])", (3, 1, 1), "'str'", "trim(m[2])", "try_cast(trim(m[2]) AS DOUBLE)"), lists=_KV),
    "list": _each(_row("ListItem", "trim(m)", (3, 2, 1)), lists=f"({_all(P.BULLET, 1)} || {_all(P.NUMBERED, 1)})"),
    "orgs": _each(_row("Organization", "m", (1, 1, 1)), _PROSE, _distinct(P.ORGANISATION, 10, 2)),
    "people": _each(_row("Person", "m", (1, 2, 1)), _PROSE, _distinct(P.PERSON, 5)),
    "locations": _each(_row("Location", "m", (5, 1, 1)), _PROSE, _distinct(P.LOCATION, 5)),
    "durations": _each(_row("Duration", "cast(cast(m[1] AS BIGINT) AS VARCHAR) || ' ' || lower(m[2])", (6, 2, 1), *_num("cast(m[1] AS DOUBLE)"), "lower(m[2])"), _PROSE, f"list_zip({_all(P.DURATION, 1)}, {_all(P.DURATION, 2)})"),
    "ratios": _each(_row("Ratio", "cast(cast(m AS DOUBLE) AS VARCHAR) || 'x'", (7, 2, 1), *_num("cast(m AS DOUBLE)"), "'x'"), _PROSE, _all(P.RATIO, 1)),
    "claims": _claims(),
    "sentiment": _sentiment(),
}


def extractions() -> str:
    union = " UNION ALL ".join(f"SELECT *, {rank} AS rank FROM ({sql})" for rank, sql in enumerate(EXTRACTORS.values()))
    return f"o_all AS ({union}), o_ext AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_seq, rank, pos) AS ext_seq FROM o_all)"


def nodes() -> str:
    return """o_coord AS (SELECT *, row_number() OVER (PARTITION BY doc_id, major, type, subtype ORDER BY ext_seq) AS instance, label || '|' || coalesce(value_str, 'None') || '|' || coalesce(unit, 'None') AS key FROM o_ext),
    o_nodes AS (SELECT doc_id, printf('%02d-%02d-%02d-%04d', major, type, subtype, instance) AS node_id, major, type, subtype, instance, label, 'prov_' || chunk_id AS prov_id, value_str, value_num, unit, substr(sha256(key), 1, 16) AS content_hash, chunk_id, ext_seq AS node_seq
      FROM o_coord QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY ext_seq) = 1)"""


def over(source: str, *parts: str, select: str) -> str:
    """WITH the views of `source`, the chunks and further parts, `select`."""
    base = ctes(source) + ", " if source.startswith("rendered") else ""
    return f"WITH {base}{', '.join([chunks(source), *parts])} {select}"
