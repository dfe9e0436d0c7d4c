"""Scalar text functions as Spark columns: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- hashes and positions


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(sha256(c), 1, n)


def line_of(text: Column, pos: Column) -> Column:
    """Line, from 1, of the character at `pos` (from 1)."""
    return F.regexp_count(F.substring(text, F.lit(1), pos - 1), F.lit("\n")) + 1


def column_of(text: Column, pos: Column) -> Column:
    """Column, from 1, of the character at `pos` (from 1) in its line."""
    before = F.substring(text, F.lit(1), pos - 1)
    return pos - (F.length(before) - F.length(F.substring_index(before, "\n", -1)))


def word_count(c: Column) -> Column:
    """Runs of at least two Latin letters."""
    return F.regexp_count(c, F.lit("[A-Za-z]{2,}"))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters of a string; null for null, 0 for ''."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(c.isNotNull(), F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


# ---------------------------------------------------------------- paths and files

# Device names that Windows reserves.
_DEVICES = "con|prn|aux|nul|com[1-9]|lpt[1-9]"


def path_problem(c: Column) -> Column:
    """Why a member path must be refused: empty, nul, absolute, drive, escape; null if it may be used."""
    p = F.regexp_replace(c, r"\\", "/")
    return (
        F.when(c.isNull() | (F.trim(c) == ""), "empty").when(F.instr(c, "\x00") > 0, "nul").when(p.startswith("/"), "absolute")
        .when(p.rlike(r"^[A-Za-z]:"), "drive").when(F.array_contains(F.split(p, "/"), ".."), "escape").when(p.rlike(":"), "stream")
    )


def member_path(c: Column) -> Column:
    """A member path with forward slashes and without empty or '.' steps; null if it must be refused."""
    steps = F.filter(F.split(F.regexp_replace(c, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    return F.when(path_problem(c).isNull() & (F.size(steps) > 0), F.array_join(steps, "/"))


def windows_hazard(c: Column) -> Column:
    """Has a path a step that Windows cannot take: a device name, or a trailing dot or blank?"""
    return F.exists(F.split(c, "/"), lambda x: F.lower(x).rlike(rf"^(?:{_DEVICES})(?:\..*)?$") | x.rlike(r"[. ]$"))


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def dir_name(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise("")


def ancestors(c: Column) -> Column:
    """Every directory above a path, '' (the root) first."""
    steps = F.split(c, "/")
    return F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


# Languages by file extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "sh": "shell", "bash": "shell", "zsh": "shell", "ps1": "powershell", "rb": "ruby", "go": "go", "rs": "rust",
    "java": "java", "php": "php", "pl": "perl", "lua": "lua", "md": "markdown", "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html", "txt": "text", "env": "dotenv", "bat": "batch", "cmd": "batch",
}


def language(path: Column, first_line: Column | None = None) -> Column:
    """Language by file name, else by the interpreter that the first line names."""
    name = F.lower(base_name(path))
    ext = F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    out = F.coalesce(F.when(name.rlike(r"^dockerfile|\.dockerfile$"), "dockerfile"), F.try_element_at(table, ext))
    if first_line is None:
        return out
    bang = F.regexp_extract(first_line, r"^#!\s*\S*?(?:/env\s+(?:-\S+\s+)*)?([A-Za-z]+)[0-9.]*\s*(?:\s.*)?$", 1)
    by_bang = F.when(bang.isin("sh", "bash", "zsh", "dash", "ksh"), "shell").when(bang.startswith("python"), "python").when(bang.isin("node", "deno", "bun"), "javascript").when(bang.isin("ruby", "perl", "php", "lua"), bang)
    return F.coalesce(out, by_bang)


# First bytes of binary formats, in hexadecimal.
MAGIC = [("7F454C46", "elf"), ("4D5A", "pe"), ("FEEDFACE", "macho"), ("FEEDFACF", "macho"), ("CEFAEDFE", "macho"), ("CFFAEDFE", "macho"), ("CAFEBABE", "macho_or_class"), ("0061736D", "wasm"), ("504B0304", "zip"), ("1F8B", "gzip"), ("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif")]


def binary_kind(content: Column) -> Column:
    """Kind of a binary file by its first bytes; 'binary' if a zero byte stands in the first 8 KiB (UTF-16 marks excepted); null for text."""
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for magic, kind in MAGIC:
        hit = head.startswith(magic) & (F.lit(True) if kind != "pe" else F.octet_length(content) >= 64)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    zero = F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*?00")
    return out.when(zero & ~head.rlike("^(?:FFFE|FEFF)"), "binary")


def archive_format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.isin("504B0304", "504B0506"), "zip").when(head.startswith("1F8B"), "tgz").when(F.decode(F.substring(content, 258, 5), "ISO-8859-1") == "ustar", "tar")


def decode_text(content: Column) -> Column:
    """struct(text, encoding): UTF-16 by its mark, UTF-8 (a mark is dropped), else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(head.startswith("FFFE"), F.struct(F.decode(F.expr(f"substring({_sql(content)}, 3)"), "UTF-16LE").alias("text"), F.lit("utf-16-le").alias("encoding")))
        .when(head.startswith("FEFF"), F.struct(F.decode(F.expr(f"substring({_sql(content)}, 3)"), "UTF-16BE").alias("text"), F.lit("utf-16-be").alias("encoding")))
        .when(utf8.isNotNull(), F.struct(F.regexp_replace(utf8, "^﻿", "").alias("text"), F.lit("utf-8").alias("encoding")))
        .when(content.isNotNull(), F.struct(F.decode(content, "ISO-8859-1").alias("text"), F.lit("latin-1").alias("encoding")))
    )


def _sql(c: Column) -> str:
    return c._jc.toString()


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression: * and ? cross slashes, [..] and [!..] are classes."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = j
        else:
            out.append("\\" + ch if not ch.isalnum() else ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


# ---------------------------------------------------------------- names, versions, URLs


def pypi_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[-_.]+", "-"))


def pin_status(spec: Column) -> Column:
    """How a package argument names its version: exact, tag, range or none."""
    v = F.regexp_extract(spec, r"^@?[^@]*@(.+)$", 1)
    return F.when(spec.rlike(r"^[\w.\-\[\]]+==[\w.!+\-]+$") | v.rlike(r"^v?\d+\.\d+\.\d+[\w.+\-]*$"), "exact").when(v.rlike(r"^[\^~<>=*]|x$|\s"), "range").when(v != "", "tag").otherwise("none")


def package_name(spec: Column) -> Column:
    """The name in a package argument: scope kept, version and extras dropped."""
    return F.regexp_extract(spec, r"^(@[^/@]+/[^@]+|[^@=<>~!\[\s]+)", 1)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@\s]*@)?(\[[0-9a-fA-F:]+\]|[^/:?#\s]+)", 1))


def is_loopback(host: Column) -> Column:
    return host.isin("localhost", "[::1]", "0.0.0.0") | host.rlike(r"^127(?:\.\d{1,3}){3}$") | host.endswith(".localhost")


def is_private_address(host: Column) -> Column:
    """Metadata hosts, link-local and private ranges."""
    return host.isin("metadata.google.internal", "metadata") | host.rlike(r"^(?:10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|169\.254(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})$")


def host_suffixes(host: Column) -> Column:
    """A host and every domain above it: a.b.c gives a.b.c, b.c and c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


# Second-level labels under which country domains register names.
_SECOND = ("co", "com", "net", "org", "gov", "edu", "ac")


def registrable_domain(host: Column) -> Column:
    parts = F.split(host, r"\.")
    n = F.size(parts)
    two_deep = (n > 2) & F.element_at(parts, -2).isin(*_SECOND) & (F.length(F.element_at(parts, -1)) == 2)
    take = F.when(two_deep, 3).otherwise(2)
    return F.when(n >= 2, F.array_join(F.slice(parts, F.greatest(n - take + 1, F.lit(1)), take), ".")).otherwise(host)


# ---------------------------------------------------------------- escapes


def md_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([\\`*_{}\[\]<>|#])", r"\\$1"), "\r?\n", " "), "\r", " ")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def js_unescape(c: Column) -> Column:
    """The common escapes of a JavaScript string; hexadecimal and Unicode escapes need `units.js_unescape`."""
    for a, b in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r"\\(['\"`\\/])", "$1")):
        c = F.regexp_replace(c, a, b)
    return c


def is_comment_line(c: Column) -> Column:
    return c.rlike(r"^\s*(?:#(?!!)|//|--\s|/\*|\*(?!\*)|<!--|;|REM\s)")


def html_comments(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)<!--(.*?)-->"), 1)


def base64_blobs(c: Column, least: int = 24) -> Column:
    """Texts that base64 runs of at least `least` characters spell: printable ASCII only."""
    runs = F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z0-9+/=])([A-Za-z0-9+/]{{{least},}}={{0,2}})(?![A-Za-z0-9+/=])"), 1)
    texts = F.transform(runs, lambda r: F.decode(F.try_to_binary(r, F.lit("base64")), "ISO-8859-1"))
    return F.filter(texts, lambda t: t.isNotNull() & t.rlike(r"^[\x20-\x7e\s]{8,}$"))


def key_locator(text: Column, *needles: Column) -> Column:
    """Line, from 1, of the last of several needles, each sought behind the one before; 0 if one is missing."""
    pos = F.lit(0)
    for n in needles:
        at = F.call_function("locate", n, text, pos + 1)
        pos = F.when(pos < 0, pos).when(at > 0, at).otherwise(-1)
    return F.when(pos > 0, line_of(text, pos)).otherwise(0)


# Public forms of tokens that are redacted wherever a snippet is shown.
TOKEN_FORMS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{10,}"


def redact_snippet(c: Column, most: int = 240) -> Column:
    """Tokens as their first four characters and a short hash, then at most `most` characters."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({TOKEN_FORMS})"), 1))
    masked = F.aggregate(found, c, lambda acc, m: F.replace(acc, m, F.concat(F.substring(m, 1, 4), F.lit("…["), short_hash(m, 8), F.lit("]"))))
    return F.substring(masked, 1, most)


def window_lines(text: Column, line: Column, n: int) -> Column:
    """The lines around line `line` (from 1), `n` on each side."""
    lines = F.split(text, "\n")
    first = F.greatest(line - n, F.lit(1))
    return F.array_join(F.slice(lines, first, line + n - first + 1), "\n")


def in_double_quotes(line: Column, pos: Column) -> Column:
    """Does the character at `pos` (from 1) lie between double quotes or back quotes of its line?"""
    before, after = F.substring(line, F.lit(1), pos - 1), F.substring(line, pos, F.length(line))
    odd = lambda q: (F.regexp_count(before, F.lit(q)) % 2 == 1) & F.contains(after, F.lit(q))
    return odd('"') | odd("`")


# What texts that speak to an agent or do something with a machine look like.
HEURISTICS = {
    "agent_directed": r"(?i)\b(?:you (?:must|should|will)|the agent|ask the user|do not)\b", "network_fetch": r"(?i)\b(?:curl|wget|fetch|download)\b", "credential_path": r"(?:~/|/home/\w+/)\.(?:ssh|aws|netrc|npmrc)|\.env\b", "read_verb": r"(?i)\b(?:reads?|loads?|opens?|collects?)\b",
    "env_dump": r"\bprintenv\b|\bos\.environ\b(?!\[)|process\.env\b(?!\.)", "persistence": r"(?i)\b(?:crontab|systemctl|launchctl|startup)\b", "instruction_file": r"\b(?:AGENTS|CLAUDE|GEMINI|SKILL)\.md\b", "destructive": r"(?i)\b(?:rm -rf|destructive|drop table|truncates?)\b",
}


def heuristics(c: Column) -> Column:
    """Names of the shared predicates that hold for a text."""
    return F.filter(F.array(*[F.when(c.rlike(rx), F.lit(k)) for k, rx in HEURISTICS.items()]), lambda x: x.isNotNull())
