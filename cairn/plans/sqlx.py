"""DuckDB expression text mirroring ``cairn.functions.text`` (oracle side only)."""

from __future__ import annotations

from cairn.functions import text as T


def q(s: str) -> str:
    """A DuckDB string literal (no backslash escapes in DuckDB literals)."""
    return "'" + s.replace("'", "''") + "'"


def name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def suffix(p: str) -> str:
    return f"regexp_extract({name(p)}, '^.+(\\.[^.]+)$', 1)"


def stem(p: str) -> str:
    return (f"CASE WHEN {suffix(p)} = '' THEN {name(p)} "
            f"ELSE regexp_replace({name(p)}, '\\.[^.]+$', '') END")


def parent(p: str) -> str:
    return f"regexp_extract({p}, '^(.*/)', 1)"


def in_list(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(q(v) for v in values)})"


def norm_path(p: str) -> str:
    return ("concat('/', translate(regexp_replace(" + p + ", '^[/\\\\]+|[/\\\\]+$', '', 'g'), '\\', '/'), '/')")


def bad_dir(p: str) -> str:
    parts = [f"strpos({norm_path(p)}, {q('/' + d + '/')}) > 0" for d in T.DIRECTORY_BLACKLIST]
    return "(" + " OR ".join(parts) + ")"


def bad_pattern(p: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({p}, {q(x)})" for x in T.PATTERN_BLACKLIST) + ")"


def allowed_suffix(p: str) -> str:
    return in_list(suffix(p), T.EXTENSION_WHITELIST + T.EXTENSIONS_CONVERT)


def encoding(content: str) -> str:
    """For text content: empty -> NULL, ASCII sample -> 'ASCII', else 'UTF-8'."""
    return (f"CASE WHEN {content} IS NULL OR {content} = '' THEN NULL "
            f"WHEN NOT regexp_matches(left({content}, {T.ENCODING_SAMPLE_BYTES}), '[^\\x00-\\x7F]') "
            f"THEN 'ASCII' ELSE 'UTF-8' END")


def disposition(p: str, content: str) -> str:
    conv = in_list(suffix(p), T.EXTENSIONS_CONVERT)
    return (f"CASE WHEN NOT {allowed_suffix(p)} THEN 'rejected_extension' "
            f"WHEN {bad_dir(p)} THEN 'rejected_directory' "
            f"WHEN {bad_pattern(p)} THEN 'rejected_pattern' "
            f"WHEN coalesce({encoding(content)} IN ('UTF-8', 'ASCII'), false) = false THEN 'rejected_encoding' "
            f"WHEN {conv} THEN 'converted' ELSE 'kept' END")


def json_len(t: str) -> str:
    c = f"regexp_replace({t}, {q(r'[\x{10000}-\x{10FFFF}]')}, {q('#' * 12)}, 'g')"
    c = f"regexp_replace({c}, {q(r'["\\\n\r\t\f\x08]')}, '##', 'g')"
    c = f"regexp_replace({c}, {q(r'[^\x20-\x7e]')}, {q('#' * 6)}, 'g')"
    return f"CAST(length({c}) AS BIGINT)"


def payload_len(p: str, c: str) -> str:
    return f"CAST({T.EMPTY_PAYLOAD_CHARS} + {json_len(p)} + {json_len(c)} AS BIGINT)"


def size_label(n: str) -> str:
    parts = []
    for i in range(len(T.SIZE_UNITS) - 1, 0, -1):
        parts.append(f"WHEN {n} >= {1024 ** i} THEN printf('%.2f {T.SIZE_UNITS[i]}', "
                     f"CAST({n} AS DOUBLE) / CAST({1024 ** i} AS DOUBLE))")
    return f"CASE {' '.join(parts)} ELSE printf('%.2f B', CAST({n} AS DOUBLE)) END"


def elapsed(s: str) -> str:
    us = f"CAST(round_even(CAST({s} AS DECIMAL(30,12)) * 1000000, 0) AS BIGINT)"
    days = f"CAST(floor({us} / 86400000000.0) AS BIGINT)"
    rest = f"({us} - {days} * 86400000000)"
    secs = f"({rest} // 1000000)"
    micro = f"({rest} % 1000000)"
    clock = f"printf('%d:%02d:%02d', {secs} // 3600, ({secs} % 3600) // 60, {secs} % 60)"
    frac = f"CASE WHEN {micro} <> 0 THEN printf('.%06d', {micro}) ELSE '' END"
    day = (f"CASE WHEN {days} = 0 THEN '' ELSE printf('%d day%s, ', {days}, "
           f"CASE WHEN abs({days}) <> 1 THEN 's' ELSE '' END) END")
    return f"({day} || {clock} || {frac})"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {q(T.TOKEN_PATTERN)})"


def sentences(t: str) -> str:
    return f"regexp_extract_all({t}, {q(T.SENTENCE_PATTERN)})"


def content_id(prefix: str, h: str, width: int = 24) -> str:
    return f"({q(prefix)} || substr({h}, 1, {width}))"


def store_id(name_expr: str) -> str:
    return content_id("vs_", f"sha256({name_expr})")
