"""Column expressions for paths, payload lengths, sizes, times, URLs and text.

Everything here builds JVM-side ``Column`` expressions (whole-stage codegen);
nothing runs Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Allowed file suffixes (case-sensitive, last suffix only).
EXTENSION_WHITELIST = (
    ".py", ".js", ".txt", ".md", ".html", ".css", ".java", ".c", ".cpp",
    ".rb", ".php", ".ts", ".json", ".xml", ".csv", ".xlsx", ".pptx", ".docx",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".pdf", ".zip", ".tar", ".tex",
)
# Suffixes still accepted by re-labelling the file as text.
EXTENSIONS_CONVERT = (".lua",)
# Encodings a selected file must have.
ENCODING_WHITELIST = ("UTF-8", "ASCII")
# Directory names excluded anywhere in the path.
DIRECTORY_BLACKLIST = (".git", "node_modules", "site-packages", ".mypy_cache")
# Unanchored path patterns excluded after the directory test.
PATTERN_BLACKLIST = (r".*\.egg-info",)
# Words that end an interactive conversation (compared lower-cased, untrimmed).
EXIT_WORDS = ("exit", "quit", ":q")
# Video URL test and video id pattern (both unanchored searches).
VIDEO_URL_PATTERN = r"(youtu\.be|(?:www\.)?youtube\.com)\/"
VIDEO_ID_PATTERN = r"(?:v=|\/)([0-9A-Za-z_-]{11}).*"
# Supported web content types, tested as prefixes in this order.
CONTENT_TYPES = (("text/plain", ".txt"), ("application/pdf", ".pdf"), ("text/html", ".html"))
# Size units, 1024 apart, the last one open-ended.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
# Maximum serialised message payload, in characters.
MAX_MESSAGE_CHARS = 256_000
# Characters of the empty payload '{"path": "", "content": ""}'.
EMPTY_PAYLOAD_CHARS = 27
# Bytes sampled for encoding detection.
ENCODING_SAMPLE_BYTES = 4096
# ---------------------------------------------------------------------------

# Our own token / sentence rules (shared with the DuckDB oracle text).
TOKEN_PATTERN = r"[\p{L}0-9]+"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
# Our own URL validity rule for routing (scheme, dotted host, optional rest).
URL_PATTERN = r"^(https?|ftp)://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:[0-9]+)?([/?#][^\s]*)?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ----------------------------- paths ---------------------------------------

def path_name(path) -> Column:
    """Last component of a '/'-separated path."""
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def path_suffix(path) -> Column:
    """Suffix of the last component: '' for no dot, a leading dot only, or a trailing dot."""
    return F.regexp_extract(path_name(path), r"^.+(\.[^.]+)$", 1)


def path_stem(path) -> Column:
    """Last component without its suffix."""
    name = path_name(path)
    return F.when(F.length(path_suffix(path)) == 0, name).otherwise(
        F.regexp_replace(name, r"\.[^.]+$", ""))


def path_parent(path) -> Column:
    """Everything before the last '/' (kept with its trailing '/')."""
    return F.regexp_extract(_c(path), r"^(.*/)", 1)


def normalized_path(path) -> Column:
    """'/' + path stripped of leading/trailing slashes or backslashes, '\\' -> '/', + '/'."""
    stripped = F.regexp_replace(_c(path), r"^[/\\]+|[/\\]+$", "")
    return F.concat(F.lit("/"), F.translate(stripped, "\\", "/"), F.lit("/"))


def has_parent_directory(path, name: str) -> Column:
    """True when ``name`` is a whole component of the path (the file's own name counts)."""
    norm_name = "/" + name.strip("/\\").replace("\\", "/") + "/"
    return F.instr(normalized_path(path), norm_name) > 0


def in_blacklisted_directory(path) -> Column:
    """Any blacklisted name as a whole component: one regex over one normalised path."""
    names = "|".join(re.escape(d) for d in DIRECTORY_BLACKLIST)
    return normalized_path(path).rlike(f"/({names})/")


def matches_blacklisted_pattern(path) -> Column:
    cond = F.lit(False)
    for p in PATTERN_BLACKLIST:
        cond = cond | _c(path).rlike(p)
    return cond


# ----------------------------- payloads ------------------------------------

def json_escaped_length(col) -> Column:
    """Length of the string as an ASCII-escaped JSON string literal, quotes excluded.

    Each character is replaced by as many '#' as its escaped form takes: astral
    characters 12 (a surrogate pair), '"', '\\' and the five short control
    escapes 2, anything else outside printable ASCII 6 ('\\uXXXX').  '#' is
    printable, so later steps leave earlier replacements alone.
    """
    c = F.regexp_replace(_c(col), r"[\x{10000}-\x{10FFFF}]", "#" * 12)
    c = F.regexp_replace(c, r'["\\\n\r\t\f\x08]', "##")
    c = F.regexp_replace(c, r"[^\x20-\x7e]", "#" * 6)
    return F.length(c).cast("bigint")


def payload_length(path, content) -> Column:
    """Characters of json.dumps({"path": path, "content": content})."""
    return (F.lit(EMPTY_PAYLOAD_CHARS) + json_escaped_length(path)
            + json_escaped_length(content)).cast("bigint")


# ----------------------------- sizes / times -------------------------------

def size_label(n_bytes) -> Column:
    """'1.12 KB'-style label: 1024 steps, capped at the last unit, 2 decimals (half-even)."""
    n = _c(n_bytes).cast("double")
    idx = F.lit(0)
    for i in range(1, len(SIZE_UNITS)):
        idx = F.when(_c(n_bytes) >= F.lit(1024 ** i), F.lit(i)).otherwise(idx)
    value = n / F.pow(F.lit(1024.0), idx)
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), idx + 1)
    return F.format_string("%.2f %s", F.bround(value, 2), unit)


def elapsed_text(seconds) -> Column:
    """'[N day(s), ]H:MM:SS[.ffffff]' for a number of seconds (microsecond, half-even)."""
    us = F.bround(_c(seconds).cast("decimal(30,12)") * F.lit(1_000_000), 0).cast("bigint")
    day_us = 86_400_000_000
    days = F.floor(us / F.lit(day_us)).cast("bigint")
    rest = F.pmod(us, F.lit(day_us))
    secs = (rest / F.lit(1_000_000)).cast("bigint")
    micro = F.pmod(rest, F.lit(1_000_000))
    clock = F.format_string("%d:%02d:%02d", (secs / 3600).cast("bigint"),
                            ((secs % 3600) / 60).cast("bigint"), secs % 60)
    clock = F.when(micro != 0, F.concat(clock, F.format_string(".%06d", micro))).otherwise(clock)
    day_txt = F.when(days == 0, F.lit("")).otherwise(
        F.format_string("%d day%s, ", days, F.when(F.abs(days) != 1, F.lit("s")).otherwise(F.lit(""))))
    return F.concat(day_txt, clock)


# ----------------------------- inputs / URLs -------------------------------

def is_exit_word(text) -> Column:
    return F.lower(_c(text)).isin(*EXIT_WORDS)


def is_video_url(url) -> Column:
    return _c(url).rlike(VIDEO_URL_PATTERN)


def video_id(url) -> Column:
    """First 11-character id after 'v=' or '/'; null when there is none."""
    return F.nullif(F.regexp_extract(_c(url), VIDEO_ID_PATTERN, 1), F.lit(""))


def is_url(text) -> Column:
    return _c(text).rlike(URL_PATTERN)


# A body that opens, after white space and comments, like an HTML page (our own rule).
HTML_START = r"(?is)^\s*(?:<!--.*?-->\s*)*<(?:!doctype html|html)"


def content_type_extension(content_type) -> Column:
    """Extension of the first supported type the header starts with; null otherwise."""
    out = F.lit(None).cast("string")
    for ctype, ext in reversed(CONTENT_TYPES):
        out = F.when(_c(content_type).startswith(ctype), F.lit(ext)).otherwise(out)
    return out


def strip_quotes(text) -> Column:
    """Strip any run of single/double quotes from both ends."""
    return F.regexp_replace(_c(text), r"^['\"]+|['\"]+$", "")


# ----------------------------- text ----------------------------------------

def tokens(text) -> Column:
    """Lower-cased letter/digit runs."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def sentences(text) -> Column:
    """Runs of non-terminator characters with their trailing terminators."""
    return F.regexp_extract_all(_c(text), F.lit(SENTENCE_PATTERN), 0)


def detect_encoding(content_bytes, total_length=None) -> Column:
    """'ASCII', 'UTF-8' or null, from the first 4 KB of a binary column.

    A multi-byte character cut at the sample edge still counts as UTF-8 when
    the file is longer than the sample.
    """
    b = _c(content_bytes)
    n = F.length(b) if total_length is None else _c(total_length)
    sample = F.substring(b, 1, ENCODING_SAMPLE_BYTES)
    as_text = sample.cast("string")
    valid = F.is_valid_utf8(as_text)
    for cut in (1, 2, 3):
        valid = valid | ((n > ENCODING_SAMPLE_BYTES)
                         & F.is_valid_utf8(F.substring(b, 1, ENCODING_SAMPLE_BYTES - cut).cast("string")))
    ascii_only = ~as_text.rlike(r"[^\x00-\x7F]") & F.is_valid_utf8(as_text)
    return (F.when(F.length(sample) == 0, F.lit(None).cast("string"))
            .when(ascii_only, F.lit("ASCII"))
            .when(valid, F.lit("UTF-8"))
            .otherwise(F.lit(None).cast("string")))
