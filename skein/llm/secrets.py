"""Credentials embedded in source code: found by a lexical pass over the text, and blanked without breaking it.

The text is lexed in islands: wherever an identifier stands, in code, configuration, prose or a comment, the tokens that
follow it are read: closing marks, a type, a connector (assignment, colon, arrow, default, argument, flag, heading in a
sentence) and a literal (quoted in any way, split over lines, or bare). Reading outward from names needs no language
and is not led astray by an apostrophe in a comment, as lexing from the top of a file is. Slots that a notation names
are read as literals of that name: the password of a URL or of a user flag, the value of a query parameter, the
credentials of an authorization header, the body of a private key block. A literal in a slot named like a credential is
a secret if it is no placeholder. Literals with the fixed public form of a provider's token, plain or in base64, are
reported under a kind of their own wherever they stand. Redaction replaces the characters of the literal only; quotes,
prefixes, escapes and line ends stay, so the text parses as before.

Values of names for passwords may be words or short phrases; values of keys and tokens may not, nor may bare words.

Defined cases: null data has no secrets; bytes are read as UTF-16 (by mark, or by their zero bytes), else UTF-8, else
Latin-1, and written back the same way with the same mark; rows that repeat count once; null elements keep their
position.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- names

_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_ONE = {"password", "passwords", "passwd", "pwd", "passphrase", "passcode", "pass", "secret", "secrets", "token", "apikey", "credential", "credentials", "cred", "creds", "bearer", "pat", "auth", "authorization", "authtoken", "accesstoken", "secretkey", "clientsecret", "privatekey", "accesskey", "pw", "smtppass", "dbpassword", "jwt"}
_BEFORE_KEY = {"api", "access", "secret", "private", "signing", "encryption", "auth", "master", "account", "session", "deploy", "ssh", "license", "webhook", "shared", "service", "client", "admin", "hmac", "cipher", "registry", "storage", "subscription", "app", "sas"}
#: Last words that make a name speak of something about a credential.
_ABOUT = {"url", "uri", "id", "ids", "name", "names", "file", "path", "dir", "length", "len", "count", "limit", "min", "max", "type", "ttl", "expiry", "expires", "policy", "field", "header", "headers", "endpoint", "env", "var", "digest", "placeholder", "hint", "label", "format", "scheme", "size", "budget", "usage", "required", "enabled", "public", "prefix", "suffix", "regex", "pattern", "provider", "manager", "store", "ref", "version", "rotation", "host", "port", "user", "username", "email"}


@lru_cache(100_000)
def is_credential_name(name: str) -> bool:
    """Is an identifier named like a credential?"""
    w = [x.lower() for x in _SPLIT.findall(name)]
    if not w or w[-1] in _ABOUT or "public" in w:
        return False
    if w[-1].isdigit():
        w = w[:-1]
        if not w or w[-1] in _ABOUT:
            return False
    return w[-1] in _ONE or (len(w) > 1 and w[-1] in ("key", "keys") and w[-2] in _BEFORE_KEY) or (len(w) > 1 and w[-1] in ("value", "val", "string", "str", "plain", "raw", "hex", "base", "b", "default", "prod", "dev", "old", "new", "live", "current", "backup") and is_credential_name("_".join(w[:-1])))


# ---------------------------------------------------------------- placeholders

_MASK = re.compile(r"[*xX•.…_\-#?\s]*|(.)\1*|<[^<>]*>|\[[^\[\]]*\]|\{\{?.*\}\}?|\$\{.*|\$\(.*|\$\w+|%\w+%|%\(.*|@\w+@|__\w+__|#\{.*|&\w+;", re.S)
_REFERENCE = re.compile(r"(?i)(?:secretref|vault|env|file|ref|keyring|keychain|op|ssm|sops|gcp|aws|arn|azure|keyvault|k8s|secret|secrets|kms|age|conjur|doppler|infisical|parameter|config|var|self|this|process|os|settings|request|req|args|options|opts|params|context|ctx|data|import)(?::|\.[A-Za-z_]|://)|(?:os|process|System|Deno|Bun|ENV|std)[.\[(:]|getenv|\.?/|~/|[A-Za-z]:\\|https?://[^@]*$")
_DIGEST = re.compile(r"(?i)(?:sha-?\d+|md5|blake\w+|integrity|crc32)[:=-]|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_WORDS = re.compile(
    r"(?i)(?:change[-_ ]?(?:me|it|this)|replace|your[-_ ]|example|placeholder|redacted|xxxx|\*\*\*|\.\.\.|…|(?<![A-Za-z0-9])(?:dummy|masked|hidden|not[-_ ]?(?:set|real|a[-_ ]real)|to[-_ ]?do|fix[-_ ]?me|insert[-_ ]|enter[-_ ]|sample|fake|goes[-_ ]here|no[-_ ]?secret|not[-_]?a[-_]?secret)(?![A-Za-z0-9])|(?:^|[-_])(?:my|the|some|a)[-_](?:secret|token|key|password|api)|test[-_]?(?:key|token|secret|password)$)"
)
_NONE = {"", "none", "null", "nil", "undefined", "true", "false", "yes", "no", "on", "off", "n/a", "na", "tbd", "unset", "empty", "default", "string", "str", "test", "foo", "bar", "value", "optional", "required", "bearer", "basic", "password", "secret", "token", "key", "apikey", "passwd", "pass", "credential", "private", "public", "auto", "prompt", "stdin", "unknown", "disabled", "enabled", "bytes", "int", "self", "any", "str | none"}


#: Names whose values people choose: words and short phrases count as secrets there.
_CHOSEN = {"password", "passwords", "passwd", "pwd", "passphrase", "passcode", "pass", "pw", "smtppass", "dbpassword"}
#: Words of messages, labels and descriptions, of which a password phrase has none.
_MESSAGE = re.compile(r"(?i)\b(?:the|is|are|be|must|may|should|your|you|please|at|least|for|to|of|in|with|from|and|or|not|no|invalid|wrong|incorrect|required|missing|empty|field|enter|type|reset|forgot|forgotten|confirm|change|new|old|minimum|maximum|length|characters?|words?|hash(?:ed)?|user|login|account|see|use|used|read|prompt(?:ed)?|string|value|passwords?|passphrase|secret|token|key|protected|policy|manager|auth|authentication)\b")


@lru_cache(100_000)
def is_chosen_name(name: str) -> bool:
    """Does an identifier name something that people choose, like a password?"""
    w = [x.lower() for x in _SPLIT.findall(name)]
    return any(x in _CHOSEN for x in w[-2:])


def is_chosen_value(v: str) -> bool:
    """May a quoted literal be a password of words: one word of 6 letters or more, or a short phrase that is no message?"""
    v = v.strip()
    if v.lower() in _NONE or _MASK.fullmatch(v) or _WORDS.search(v) or _REFERENCE.match(v) or _DIGEST.match(v) or _MESSAGE.search(v.replace("_", " ").replace("-", " ")):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v):
        return False
    return bool(re.fullmatch(r"[^\W\d_]{6,}|[^\W\d_]+(?:[-_.][^\W_]+)+|[^\s:;,.?!(){}<>]+(?: [^\s:;,.?!(){}<>]+){2,7}", v))


def is_placeholder(v: str, deep: bool = True) -> bool:
    """Is a literal no secret: empty, masked, a stand-in, a reference, a digest or an id?"""
    v = v.strip().strip("\"'`")
    if v.lower() in _NONE or len(v) < 6 or _MASK.fullmatch(v) or _WORDS.search(v) or _REFERENCE.match(v) or _DIGEST.match(v):
        return True
    if re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:[_ -][a-z]+)*|[a-z]{2,}(?:[A-Z][a-z]{2,})+|[A-Z][a-z]+(?: [a-z]+)*|\d{1,15}(?:\.\d+)*|v?\d+\.\d+\.\d+\S*", v) and not _KNOWN.fullmatch(v):
        return True
    if deep and (plain := unbase64(v)) is not None:
        return is_placeholder(plain.split(":", 1)[-1], deep=False)
    return False


@lru_cache(10_000)
def unbase64(v: str) -> str | None:
    """The printable text that a literal spells in base64."""
    if len(v) < 8 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", v):
        return None
    try:
        raw = base64.b64decode(v.replace("-", "+").replace("_", "/") + "=" * (-len(v) % 4), validate=True)
        text = raw.decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if text and all(32 <= ord(c) < 127 or c in "\r\n\t" for c in text) else None


# ---------------------------------------------------------------- forms that are secrets wherever they stand

# Public forms of providers' tokens.
_FORMS = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{22,}", r"glpat-[A-Za-z0-9_\-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}", r"xapp-[A-Za-z0-9-]{10,}", r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}", r"sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_\-]{20,}",
    r"AIza[A-Za-z0-9_\-]{35}", r"ya29\.[A-Za-z0-9_\-]{20,}", r"npm_[A-Za-z0-9]{30,}", r"pypi-[A-Za-z0-9_\-]{30,}", r"hf_[A-Za-z0-9]{30,}", r"dop_v1_[a-f0-9]{60,}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", r"eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{10,}", r"[a-z]{2,5}-(?:live|prod)-[A-Za-z0-9]{16,}", r"shp(?:at|ss|ca)_[a-fA-F0-9]{32}", r"key-[0-9a-f]{32}", r"AGE-SECRET-KEY-1[A-Z0-9]{50,}",
]
_KNOWN = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(_FORMS) + r")(?![A-Za-z0-9_])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_BEGIN, _END = re.compile(r"-----BEGIN [A-Z0-9 ]{1,60}-----"), re.compile(r"-----END [A-Z0-9 ]{1,60}-----")
_URL = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*+://(?P<user>[^\s/:@\"'`<>]*):(?P<pw>[^\s/@\"'`<>]+(?:@[^\s/@\"'`<>.]*(?=@))?)@")
_QUERY = re.compile(r"(?i)[?&;](?P<name>[A-Za-z0-9_.\-]*(?:key|token|secret|sig|signature|password|passwd|pwd|auth|credential|apikey|jwt|code))=(?P<v>[^&#\s\"'`<>\\]+)")
_SCHEME = re.compile(r"(?i)\b(?:Bearer|Basic|Token|ApiKey)[ \t]+(?P<v>[A-Za-z0-9+/_\-.=~!#$%*?@:&]{6,})")
_CURL = re.compile(r"(?:\s|[\"'])(?:-u|--user)(?:[ =]|\"\s*,\s*\")[\"']?(?P<user>[^\s:\"']+):(?P<v>[^\s\"']+)")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_\-.=])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=])")

#: Kind of the further pieces of a literal that is written in several.
MORE = "continued"

# ---------------------------------------------------------------- the lexical pass

_NAME = re.compile(r"(?:--?)?[A-Za-z_$][A-Za-z0-9_]*(?:(?:[.\-]|\?\.|->|::)[A-Za-z_][A-Za-z0-9_]*)*")
_CLOSE = re.compile(r"(?:\\?[\"'`\])]|\*\*|\*|__|</?[a-z]+>)*")
_TYPE = re.compile(r"\s*[:]\s*(?:readonly\s+)?&?(?:'static\s+)?[A-Za-z_][\w.]*(?:\s*[\[<][^\]>=\n]*[\]>])?(?:\s*\|\s*[\w.]+)*\??(?=\s*=\s*[rRbBfFuU]{0,2}[\"'`(])")
_LINK = re.compile(r"[ \t]*(?:===?|!==?|=>|:=|\?=|\|\|=?|\?\?=?|\?:|[=:]|\bor\b|\bis\b|\bto\b|\bequals\b|->)[ \t]*|(?<=[\"'`])[ \t]*,[ \t]*|[ \t]+(?=`)|[ \t]*\|[ \t]+(?![|\-])|>(?=[^<>\s]+</)|\([ \t]*(?=[\"'`]|[rbfuRBFU]{1,2}[\"'])")
_OPEN = re.compile(r"(?:[(\[{]|[|>][-+]?\d?|\\)?[ \t]*(?:(?:#|//)[^\n]*)?\r?\n[ \t]*(?:[+>][ \t]*)?|[(\[][ \t]*|String\(|Buffer\.from\(|b64decode\(|atob\(|SecretStr\(|str\(")
_QUOTE = re.compile(r"(?:[rRbBfFuU]{1,2}|@|\$|[lL])?(?P<q>\"\"\"|'''|\\\"|\\'|[\"'`])")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+(?:[^\s\"'`,;<>]*[^\s\"'`,;<>)\]}])?")
_FALLBACK = re.compile(r"(?:\|\||\?\?|\bor\b|\belse\b|,|\?:)[ \t]*$")


class Lines:
    """Where quotes and line ends stand in a text, looked up from the left in constant time on average."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.none: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """The next place of `what` from `at`, -1 for none; a search that failed once is not repeated further right."""
        if at >= self.none.get(what, len(self.text) + 1):
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none[what] = min(at, self.none.get(what, at))
        return found


def _literal(text: str, at: int, lines: Lines) -> tuple[int, int, bool] | None:
    """(start, end, quoted) of the literal at `at`: the contents of a string, or a bare word."""
    m = _QUOTE.match(text, at)
    if m:
        q, i = m["q"], m.end()
        line = lines.find("\n", i) if len(q) == 1 and q != "`" or q[0] == "\\" else -1
        far = len(text) if line < 0 else line
        if q[0] == "\\":
            end = text.find(q, i, far)
            return (i, end, True) if end >= 0 else None
        # An ordinary string ends on its line; the others may go on to the end of the text.
        j = i
        while 0 <= (end := (text.find(q, j, far) if far < len(text) else lines.find(q, j))):
            k = end
            while k > i and text[k - 1] == "\\":
                k -= 1
            if (end - k) % 2 == 0:
                break
            j = end + 1
        if end < 0:
            return None
        return i, end, True
    m = _BARE.match(text, at)
    return (m.start(), m.end(), False) if m else None


_GLUE = re.compile(r"[ \t]*(?:[+.\\][ \t]*)?(?:\r?\n[ \t]*(?:[+.][ \t]*)?)?")
_NEXT = re.compile(r"[rRbBfFuU]{0,2}[\"']")
_KEYED = re.compile(r"[\"']?[ \t]*[:=]")


def _pieces(text: str, start: int, end: int, lines: Lines) -> list[tuple[int, int]]:
    """A string literal and those that follow it as one (adjacent or joined by +, . or a backslash), however many."""
    out = [(start, end)]
    at = end + 1
    while True:
        m = _GLUE.match(text, at)
        if not m or m.end() == at or not _NEXT.match(text, m.end()):
            return out
        nxt = _literal(text, m.end(), lines)
        if not nxt or not nxt[2] or _KEYED.match(text, nxt[1] + 1):
            return out
        out.append((nxt[0], nxt[1]))
        at = nxt[1] + 1


def _frames(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks between BEGIN and END lines."""
    out, at = [], 0
    while (b := _BEGIN.search(text, at)) and (e := _END.search(text, b.end())):
        out.append((b.start(), e.end()))
        at = e.end()
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secret literals of a text, in order, not overlapping."""
    hits: list[tuple[int, int, str]] = []
    add = lambda s, e, kind: hits.append((s, e, kind))
    for m in _PEM.finditer(text):
        body = re.sub(r"\\[nr]|\s|[\"'+,;>|#*/]|^[A-Za-z-]+: .*$", "", m["body"])
        if len(re.sub(r"[^A-Za-z0-9]", "", body)) >= 24 and not _WORDS.search(body[:200]) and len(set(body)) > 8:
            add(m.start(), m.end(), "private_key")
    blocked = _frames(text)
    inside = lambda i: (k := bisect_right(blocked, (i, len(text)))) > 0 and i < blocked[k - 1][1]
    for m in _URL.finditer(text):
        pw = m["pw"]
        if not (pw.startswith(("$", "{", "%{", "<")) or is_placeholder(pw) and len(pw) >= 6 or _MASK.fullmatch(pw) or _WORDS.search(pw) or pw.lower() in _NONE):
            add(m.start("pw"), m.end("pw"), "url_password")
    for m in _QUERY.finditer(text):
        if not is_placeholder(m["v"]) and len(m["v"]) >= 8:
            add(m.start("v"), m.end("v"), "query")
    for m in _SCHEME.finditer(text):
        v = m["v"]
        if not is_placeholder(v) and (text[m.start() : m.start() + 5].lower() == "basic" and (unbase64(v) or "").count(":") or _random(v)):
            add(m.start("v"), m.end("v"), "header")
    for m in _CURL.finditer(text):
        if not is_placeholder(m["v"]):
            add(m.start("v"), m.end("v"), "password")
    for m in _KNOWN.finditer(text):
        if not _WORDS.search(m[0]) and len(set(m[0][4:])) > 4:
            add(m.start(), m.end(), "provider")
    for m in _B64.finditer(text):
        plain = unbase64(m[0])
        if plain and not inside(m.start()) and (_KNOWN.search(plain) and not _WORDS.search(plain) or "PRIVATE KEY-----" in plain or any(not is_placeholder(x["pw"]) for x in _URL.finditer(plain))):
            add(m.start(), m.end(), "base64")
    lines, until = Lines(text), 0
    for m in _NAME.finditer(text):
        name = m[0]
        if m.start() < until:
            continue  # inside a literal that was read already
        if text.startswith("(", m.end()) and _LOGIN.search(name):
            if (spot := _password_argument(text, m.end() + 1, lines)) and (not is_placeholder(text[spot[0] : spot[1]]) or is_chosen_value(text[spot[0] : spot[1]])):
                add(*spot, "argument")
            continue
        flag = name.startswith("-")
        if not is_credential_name(name):
            continue
        for n, (s, e) in enumerate(_after(text, m.start(), m.end(), name, flag, lines)):
            add(s, e, MORE if n else "assigned")
            until = e
    hits.sort(key=lambda h: (h[0], -h[1]))
    out: list[tuple[int, int, str]] = []
    for s, e, kind in hits:
        if out and s < out[-1][1]:
            continue
        out.append((s, e, kind))
    return out


def _random(v: str) -> bool:
    """Does a bare word look like a key or a password rather than a word?"""
    return len(v) >= 8 and (any(c.isdigit() for c in v) or (len(set(v)) > 12 and not (v.isalpha() and (v.islower() or v.isupper()))))


#: Calls that take a user and a password by position.
_LOGIN = re.compile(r"(?i)(?:^|[._]|(?<=[a-z]))(?:log_?in|log_?on|sign_?in|authenticate|basic_?auth|http_?basic_?auth|digest_?auth|set_?credentials|password_?credentials?|username_?password\w*)$")
_ARGUMENT = re.compile(r"\s*(?:[A-Za-z_][\w.]*|[rRbBfFuU]{0,2}(?P<q>[\"'])(?:\\.|(?!(?P=q))[^\\\n])*(?P=q))\s*,\s*(?=[rRbBfFuU]{0,2}[\"'])")


def _password_argument(text: str, at: int, lines: Lines) -> tuple[int, int] | None:
    """The literal that a call for a login has as its second argument."""
    m = _ARGUMENT.match(text, at)
    lit = _literal(text, m.end(), lines) if m else None
    return (lit[0], lit[1]) if lit and lit[2] else None


#: A value beside its name in another attribute of an element, and commands that set a name to the word behind it.
_ATTRIBUTE = re.compile(r"[\"'][ \t]+value[ \t]*=[ \t]*(?=[\"'])")
_BLANKS = re.compile(r"[ \t]+(?=[^\s=:#])")
_SETTING = re.compile(r"(?m)(?:^|[;&|]|RUN)[ \t]*(?:ENV|ARG|setenv|set[ \t]+-[a-zA-Z]+|setx)[ \t]+$")


def _after(text: str, begin: int, at: int, name: str, flag: bool, lines: Lines) -> list[tuple[int, int]]:
    """The non-placeholder literals assigned or passed to the identifier that ends at `at`."""
    quoted = begin > 0 and text[begin - 1] in "\"'`"
    i = _CLOSE.match(text, at).end()
    spec = re.compile(r"[\"']?[ \t]*,[ \t]*\\?[\"']?value\\?[\"']?[ \t]*[:=][ \t]*|[\"']?[ \t]*\r?\n[ \t-]*[\"']?value[\"']?[ \t]*:[ \t]*").match(text, at)
    word = False
    if quoted and (pair := _ATTRIBUTE.match(text, at)):
        i = pair.end()
    elif (sp := _BLANKS.match(text, i)) and _SETTING.search(text[max(0, begin - 24) : begin]):
        i = sp.end()
    elif spec and re.compile(r"(?s).*name\W*$").match(text[max(0, begin - 16) : begin]):
        i = spec.end()
    else:
        if t := _TYPE.match(text, i):
            i = t.end()
        link = _LINK.match(text, i)
        if link:
            sign = link[0].strip()
            word = sign in ("is", "to", "equals", "", "|", "or")
            if sign == "," and not quoted and not flag:
                return []
            if sign in ("==", "===", "!=", "!=="):
                return []
            i = link.end()
        elif flag and (sp := re.compile(r"[ \t]+(?!-)").match(text, i)):
            i = sp.end()
        else:
            return []
    if o := _OPEN.match(text, i):
        newline = "\n" in o[0]
        if newline and not re.compile(r"[(\[{|>\\]").search(o[0].split("\n")[0]) and not _QUOTE.match(text, o.end()):
            return []
        i = o.end()
    lit = _literal(text, i, lines)
    if not lit:
        return []
    s, e, q = lit
    value = text[s:e]
    if not q:
        # A bare expression may fall back to a literal: getenv("X") or "literal".
        mark = min((p for p in (lines.find(q, i) for q in "\"'`") if p >= 0), default=-1)
        if mark >= 0 and _FALLBACK.search(text[max(i, mark - 24) : mark]) and not 0 <= lines.find("\n", i) < mark:
            nxt = _literal(text, mark, lines)
            if nxt and nxt[2] and not is_placeholder(text[nxt[0] : nxt[1]]) and _REFERENCE.match(value):
                return [(nxt[0], nxt[1])]
        if text[e : e + 1] == "(" or (word and not _random(value)):
            return []
        value = value.rstrip(".,;:") if word else value
        e = s + len(value)
    scheme = re.compile(r"(?i)(?:Bearer|Basic|Token|ApiKey)[ \t]+").match(value)
    if scheme:
        s += scheme.end()
        value = text[s:e]
        if not q and not value:
            return []
    if q:
        parts = _pieces(text, s, e, lines) if text[e : e + 1] in "\"'" else [(s, e)]
        value = "".join(text[a:b] for a, b in parts)
        if "\n" in value.strip("\n") and "-----" in value:
            return []
        chosen = not word and is_chosen_name(name) and is_chosen_value(value)
        if not chosen and (is_placeholder(value) or " " in value.strip()) or _URL.match(value) or re.match(r"[a-z]+://", value):
            return []
        lead = len(value) - len(value.lstrip())
        return [(parts[0][0] + lead, parts[0][1]), *parts[1:]]
    if is_placeholder(value) or re.match(r"[a-z+]+://|-----", value):
        return []
    return [(s, e)]


# ---------------------------------------------------------------- redaction

_ESC = re.compile(r"\\(?:u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|\r?\n[ \t]*|-----(?:BEGIN|END) [A-Z0-9 ]+-----", re.S)


def blank(text: str, spans: list[tuple[int, int, str]], mark: str = "*") -> str:
    """The text with each character of the literals replaced; escapes, line ends, indents and the frames of key blocks stay."""
    out, at = [], 0
    for s, e, _ in spans:
        out.append(text[at:s])
        part, i = text[s:e], 0
        for m in _ESC.finditer(part):
            out.append(mark * (m.start() - i) + m[0])
            i = m.end()
        out.append(mark * (len(part) - i))
        at = e
    return "".join([*out, text[at:]])


def decode(data: bytes) -> tuple[str, str, bytes]:
    """(text, encoding, mark) of a file's bytes; the same three give the bytes back."""
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(enc, "surrogatepass"), enc, mark
            except UnicodeDecodeError:
                return data.decode("latin-1"), "latin-1", b""
    if len(data) > 3 and len(data) % 2 == 0 and 0 in data:
        for enc, zero in (("utf-16-le", data[1::2]), ("utf-16-be", data[::2])):
            if zero.count(0) > 0.7 * len(zero):
                try:
                    return data.decode(enc), enc, b""
                except UnicodeDecodeError:
                    pass
    try:
        return data.decode("utf-8"), "utf-8", b""
    except UnicodeDecodeError:
        return data.decode("latin-1"), "latin-1", b""


def encode(text: str, enc: str, mark: bytes) -> bytes:
    return mark + text.encode(enc, "surrogatepass" if enc != "latin-1" else "strict")


# ---------------------------------------------------------------- over tables


def in_blobs(blobs: DataFrame, row_id: str, data: str) -> DataFrame:
    """(row_id, line, kind): every secret with the line, from 1, on which its value begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, kinds = [], [], []
            for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d is None:
                    continue
                text = decode(d)[0]
                at = line = 0
                for s, _, kind in find(text):
                    line += text.count("\n", at, s)
                    at = s
                    if kind != MORE:
                        ids.append(i)
                        lines.append(line + 1)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], names=["row_id", "line", "kind"])

    return blobs.select(F.col(row_id).cast("bigint"), data).mapInArrow(run, "row_id bigint, line int, kind string")


def redact_blobs(blobs: DataFrame, row_id: str, data: str) -> DataFrame:
    """(row_id, n_secrets, redacted): each file with its secrets blanked, in its own encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for d in b.column(1).to_pylist():
                if d is None:
                    n.append(0)
                    out.append(None)
                    continue
                text, enc, mark = decode(d)
                spans = find(text)
                n.append(len(spans))
                out.append(encode(blank(text, spans), enc, mark) if spans else d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(out, pa.binary())], names=["row_id", "n_secrets", "redacted"])

    return blobs.select(F.col(row_id).cast("bigint"), data).mapInArrow(run, "row_id bigint, n_secrets int, redacted binary")


def in_elements(specs: DataFrame, row_id: str, names: str) -> DataFrame:
    """(row_id, pos, kind, redacted): the elements of a list of texts that hold a secret, positions from 1."""
    rows = specs.select(F.col(row_id).cast("bigint").alias("row_id"), F.posexplode(names).alias("p", "t")).filter("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, kinds, red = [], [], [], []
            for i, p, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                spans = find(t)
                if spans:
                    ids.append(i)
                    pos.append(p + 1)
                    kinds.append(spans[0][2])
                    red.append(blank(t, spans))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(kinds, pa.string()), pa.array(red, pa.string())], names=["row_id", "pos", "kind", "redacted"])

    return rows.mapInArrow(run, "row_id bigint, pos int, kind string, redacted string")
