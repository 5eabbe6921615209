"""Problem 2: credentials embedded in source code, found lexically and masked in place.

A text that holds a cue anywhere is read whole, once, as a sequence of tokens (names, string literals, operators, line ends);
what stands inside a literal of several lines is read as text of its own, too, as a chunk may start in the middle of one. A
literal is a candidate if it is assigned or passed to a name of a credential. Formats without quotes have their own readers
of the lines with a cue: settings (name = value), markup (elements and attributes), command options, and the forms that stand
inside literals and comments: connection URLs, headers, logins, issued keys, key blocks. Candidates that are placeholders,
references, prompts, patterns or digests are dropped. Masking replaces only the characters of the literal: quotes, line ends
and the escapes of these stay, and a character written as a number in an escape is replaced by another one written so.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MASK = "REDACTED"

# Words of names that hold credentials, and words that turn such a name into something else.
_STRONG = {"password", "passwd", "passwort", "kennwort", "passphrase", "passcode", "pwd", "pass", "pw", "secret", "credential", "credentials", "apikey", "contrasena", "motdepasse", "senha", "wachtwoord", "apitoken", "authtoken"}
_KEY_BEFORE = {"api", "signing", "service", "encryption", "private", "access", "secret", "master", "auth", "license", "account", "storage", "shared", "crypto", "encrypt", "signature", "hmac", "deploy", "ssh", "app", "root", "admin", "subscription", "raw", "jwt", "session", "cipher", "aes", "webhook"}
_TOKEN_BEFORE = {"auth", "access", "refresh", "deploy", "private", "api", "bearer", "session", "personal", "bot", "service", "csrf", "id", "user", "admin", "registry", "webhook", "github", "gitlab", "slack", "jwt", "oauth", "x", "secret", "security", "login", "app", "client", "upload", "publish", "npm", "pypi", "ci"}
_PIN_AFTER = {"code", "number"}
_OFF = {"label", "pattern", "regex", "prompt", "hint", "ref", "reference", "hash", "hashed", "checksum", "digest", "sum", "path", "file", "filename", "dir", "url", "uri", "endpoint", "length", "len", "min", "max", "ttl", "count", "field", "column", "header", "type", "policy", "expiry", "expires", "public", "pub", "placeholder", "message", "msg", "error", "help", "description", "title", "text", "env", "var", "name", "id", "arn", "store", "provider", "manager", "reset", "rotation", "enabled", "required", "version", "algorithm", "alg", "format", "prefix", "suffix", "example", "count", "size", "index", "limit", "bucket", "vocab", "kind"}
_LOGIN = {"login", "signin", "logon", "connect", "authenticate", "auth", "basicauth", "setcredentials", "withcredentials", "usernamepassword", "basic"}

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# A line is read only if its lower-cased text holds one of these; plain substring search keeps the rest of the corpus cheap.
_CUES = (
    "pass", "pwd", "pw", "secret", "token", "key", "kennwort", "credential", "auth", "login", "log in", "logon", "signin", "sign_in", "sign-in",
    "connect(", "pin", "identified by", "bearer", "basic", "--user", "-----begin", "senha", "contrase", "motdepasse", "wachtwoord",
    " -u ", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "aiza", "cix_", "xox", "eyj", "glpat-", " / ",
)
_TOK = re.compile(
    r"(?P<triple>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')"
    r"|(?P<str>\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n])*'|`[^`]*`)"
    r"|(?P<id>[A-Za-z_$][\w$]*(?:[.\-](?=[A-Za-z_])[A-Za-z_][\w$]*)*)"
    r"|(?P<nl>\n)|(?P<num>\d[\w.]*)|(?P<op>:=|=>|==|!=|<=|>=|->|&&|\|\||[^\s\w])",
    re.S,
)
_KEYBLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
_KEYEND = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOUR = re.compile(r"(?:[A-Za-z0-9+/=]|\\[nr]|[\s\"'+,\\]|[A-Za-z-]+: [^\n]*(?=\n))*")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s/:@'\"`<>]*):([^\s@/'\"`<>]+)@[\w.\-\[\]$({]")
_HEADER = re.compile(r"(?i)\b(?:proxy-)?authorization\W{1,8}(?:bearer|basic|token|apikey)\s+([^\s'\"`,;<>\\)]+)|\b(?:x-auth(?:-token|-key)?|x-api-key|api-key|x-access-token|private-token)\s*['\"]?\s*[:=]\s*['\"]?([^\s'\"`,;<>\\)]+)|['\"`](?:bearer|basic)\s+([^\s'\"`,;<>\\)]+)")
_OPTION = re.compile(r"(?i)(?<![\w-])--?([a-z][\w\-]*)(?:\s+|=)(?:'([^'\n]*)'|\"([^\"\n]*)\"|([^\s'\"`\\]+))")
_USERPASS = re.compile(r"(?<![\w-])(?:-u|--user)[\s=]+['\"]?([^\s:'\"`]+):([^\s'\"`]+)")
_SQL = re.compile(r"(?i)\b(?:password|identified\s+by(?:\s+password)?)\s+(?:=\s*)?['\"]([^'\"\n]+)['\"]")
_PROSE = re.compile(r"(?i)\b(?:password|passwd|passwort|kennwort|secret|token|api key|key|pin|passphrase)\b\s*(?:is|was|ist|:|=|->)?\s*`([^`\n]+)`")
_SLASHED = re.compile(r"(?:^|\s)(?://|#|--|/\*|\*|;|<!--|%|REM)[^\n]*?\b([A-Za-z][\w.@\-]*) / ([^\s/][^\s]{5,})")
_XML_TAG = re.compile(r"<([A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>([^<>\n]+)</\1>")
_XML_ATTR = re.compile(r"\b(?:name|key|id)\s*=\s*\"([^\"]+)\"[^<>]*?\bvalue\s*=\s*\"([^\"]*)\"|\bvalue\s*=\s*\"([^\"]*)\"[^<>]*?\b(?:name|key|id)\s*=\s*\"([^\"]+)\"")
_CONFIG = re.compile(r"^[ \t]*(?:(?:#|//|--|;|\*)[ \t]*)?(?:-[ \t]+)?(?:(?:export|ENV|ARG|set|SET|LABEL)[ \t]+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*[:=][ \t]*(.*?)[ \t\r]*$")
_INLINE_ENV = re.compile(r"(?<![\w.])((?:[A-Z][A-Z0-9]*_)*(?:[A-Z][A-Z0-9]*))=([^\s'\"`;&|]+)")
_ISSUED = re.compile(r"(?<![A-Za-z0-9_/+\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_\-]{24,}|AIza[\w\-]{30,}|[a-z]{2,5}_(?:(?:live|svc|pat|test|key)_)?(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Z])[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9\-]{16,}|glpat-[\w\-]{18,}|eyJ[\w\-]{10,}\.eyJ[\w\-]{10,}\.[\w\-]{10,})")

#: A further part of a literal: after a plus, or on the next line.
_GOES_ON = re.compile(r"\s*(?:\+|\.|\\)?\s*(?:\+\s*)?(['\"])((?:[^'\"\\\n]|\\.)*)\1")
#: A character written as a number.
_NUMBERED = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,6})\}|([0-3][0-7]{2}))")
_PLACE = re.compile(
    r"(?i)^(?:change.?me|changeit|todo|fixme|tbd|none|null|nil|undefined|n/?a|unset|empty|dummy|example|sample|test|testing|placeholder|password|passwd|pwd|secret|token|key|api.?key|redacted|masked|hidden|removed|string|str|value|insert.*|replace.*|enter.*|your.*|my[-_].*|some[-_].*|the[-_].*|put[-_].*|fill.*|to.?be.*|default|foo|bar|baz|true|false|yes|no|on|off|required|optional|abc123?|12345\d*|0+|(.)\1{3,})$"
)
_REF = re.compile(r"^(?:\$|%[A-Za-z_({]|@[A-Za-z_{(]|\{\{|<|\[|#\{|&[a-z]|!|env[:.(]|vault[:./]|ssm:|arn:|secret[-_]?store|secret[-_]?manager|secretsmanager|kms:|file:|process\.env|os\.|System\.|var\.|local\.|data\.|op://|keyring)|\$\{|\{\{|\}\}|[({\[]$")
_MASKED = re.compile(r"^[*x•.#X\-_?]{3,}$|\*{3,}|x{6,}|X{6,}|•{2,}|\.\.\.$|…|<[^>]*>|(?i:example|placeholder|changeme|redacted|dummy|your[-_]|not[-_]?a[-_]?real)")
_REGEX = re.compile(r"\[[^\]]*\][{+*]|\\[dwsb]|\(\?|\)\||\|[A-Z]|\{\d+(?:,\d*)?\}|\.\*|\.\+")
_WORDY = re.compile(r"^[a-z]+(?:[-_./ ][a-z]+)*[-_]?\d{0,3}$")
_DIGESTY = re.compile(r"(?i)^(?:sha\d*[:-]|md5[:-]|h1:)")
CODE = {"py", "js", "ts", "tsx", "jsx", "java", "go", "kt", "rs", "c", "cc", "cpp", "h", "cs", "rb", "php", "swift", "scala", "mjs", "cjs"}


def name_words(name: str) -> list[str]:
    """The words of an identifier in snake, kebab, dotted or camel case, in lower case."""
    return [w.lower() for w in _WORDS.findall(name)]


def name_strength(name: str) -> int:
    """2 for a name that holds a credential, 1 for one that may (a bare token or key), 0 otherwise."""
    words = name_words(name)
    if not words:
        return 0
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _OFF or "public" in words or "label" in words or "hash" in words:
        return 0
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    joined = before + last
    if last in _STRONG or joined in _STRONG or (last == "value" and before in _STRONG):
        return 2
    if last == "word" and before == "pass":
        return 2
    if last == "key" and before in _KEY_BEFORE or last == "keys" and before in _KEY_BEFORE:
        return 2
    if last == "token" and before in _TOKEN_BEFORE:
        return 2
    if last in _PIN_AFTER and before == "pin" or last == "pin":
        return 2
    if last in ("token", "tokens", "auth", "authorization", "bearer"):
        return 1
    if name_words(name) and any(w in _STRONG for w in words[-2:]) and words[-1] in ("default", "prod", "production", "staging", "dev", "live", "old", "new", "main", "backup", "local"):
        return 2
    return 0


def looks_random(v: str) -> bool:
    """At least two of: upper case, lower case, digit, sign; or a long digest-like run. Not a plain word or word list."""
    if len(v) < 6 or _WORDY.match(v):
        return False
    kinds = bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\s]", v))
    return kinds >= 3 or (kinds == 2 and len(v) >= 8 and (bool(re.search(r"\d", v)) or bool(re.search("[a-z][A-Z]|[A-Z]{2}[a-z]", v)))) or bool(re.fullmatch(r"[0-9a-fA-F-]{24,}", v))


def is_secret(value: str, strength: int) -> bool:
    """Whether a literal in the place of a credential is one: not empty, masked, a placeholder, reference, prompt, pattern or digest."""
    v = value.strip()
    if len(v) < 4 or _PLACE.match(v) or _REF.search(v) or _MASKED.search(v) or _DIGESTY.match(v):
        return False
    if re.search(r"\s", v):  # several words: a passphrase only if most of them mix letters with digits or signs
        parts = v.split()
        odd = sum(bool(re.search(r"[A-Za-z]", w)) and bool(re.search(r"\d|[^\w\s.,:;!?'\")]|[!?.,:;](?=\w)", w)) for w in parts)
        return strength >= 2 and 2 * odd > len(parts) and not _REGEX.search(v) and not re.search(r"[={}()<>]", v)
    if _REGEX.search(v) or v.startswith(("http://", "https://", "/", "./", "~/")) and not looks_random(v.rsplit("/", 1)[-1]):
        return False
    if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*\(.*\)?;?", v) or re.fullmatch(r"[a-z_]\w*(?:\.[a-z_]\w*)+", v):
        return False
    if re.fullmatch(r"[A-Z][A-Z]*(?:_[A-Z]+)+", v):  # the name of a variable
        return False
    if strength >= 2:
        return not _WORDY.match(v) or bool(re.fullmatch(r"[a-z]{3,}\d{3,}", v)) or bool(re.fullmatch(r"(?=.*\d)[a-z0-9]{8,}", v) and not re.fullmatch(r"[a-z]+\d{0,3}", v))
    return looks_random(v) and len(v) >= 8


def _ext(path: str | None) -> str:
    base = (path or "").rsplit("/", 1)[-1].lower()
    return base.rsplit(".", 1)[-1] if "." in base else base


def _literal_candidates(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, strength) of literals tied to a credential name among the tokens of text[lo:hi]."""
    flat = []
    for m in _TOK.finditer(text, lo, hi):
        kind = m.lastgroup
        if kind == "nl":
            continue
        flat.append((kind, m.start(), m.end()))
        if kind in ("triple", "str") and text.find("\n", m.start(), m.end()) >= 0:
            n = 3 if kind == "triple" else 1
            yield from _literal_candidates(text, m.start() + n, m.end() - n)

    def word(k: int) -> str:
        return text[flat[k][1] : flat[k][2]] if 0 <= k < len(flat) else ""

    def body(k: int) -> tuple[int, int]:
        n = 3 if flat[k][0] == "triple" else 1
        return flat[k][1] + n, flat[k][2] - n

    for k, (kind, a, b) in enumerate(flat):
        if kind not in ("str", "triple"):
            continue
        if word(k + 1) == ":" and word(k - 1) in ("{", ",", ""):  # the name of an entry
            continue
        s, e = body(k)
        j = k - 1
        while j >= 0 and word(j) in ("(", "[", "{", "f", "b", "r", "u", "String", "byte", "bytes", "new") and word(j) != "":
            if word(j) == "(" and j > 0 and flat[j - 1][0] == "id" and word(j - 1) not in ("bytes", "String", "str", "byte", "Some", "Optional.of", "Buffer.from"):
                break
            j -= 1
        p = word(j)
        strength = 0
        if p in ("=", ":=", ":", "=>", "||", "?", "??", "or"):
            if p in ("||", "or", "??"):  # a default after a lookup: name = lookup || "literal"
                back = j
                while back > 0 and word(back) not in ("=", ":=", ":") and text.find("\n", flat[back][1], flat[back + 1][1]) < 0:
                    back -= 1
                j = back
                if word(j) not in ("=", ":=", ":"):
                    continue
            n = j - 1
            if word(n) == "]" and flat[n - 1][0] == "str":
                n -= 1
            if n >= 0 and flat[n][0] == "str":
                x, y = body(n)
                strength = name_strength(text[x:y])
            elif n >= 0 and flat[n][0] == "id":
                strength = name_strength(word(n))
                if not strength and word(n - 1) in (":", ")") and n >= 2 and flat[n - 2][0] == "id":  # name: type = literal
                    strength = name_strength(word(n - 2))
                if not strength and n >= 1 and flat[n - 1][0] == "id" and word(n) in ("string", "str", "String"):  # name string = literal
                    strength = name_strength(word(n - 1))
        elif p in (",", "(") and j >= 1:
            if p == "," and flat[j - 1][0] == "str" and word(j - 2) == "(":
                x, y = body(j - 1)
                call = word(j - 3)
                last = call.rsplit(".", 1)[-1].lower().replace("_", "")
                strength = name_strength(text[x:y])
                if not strength and last in _LOGIN:
                    strength = 1 if _WORDY.match(text[s:e]) else 2
            elif p == "," and flat[j - 1][0] == "id" and word(j - 2) == "(" and word(j - 3).rsplit(".", 1)[-1].lower().replace("_", "") in _LOGIN:
                strength = 2
            elif p == "(" and flat[j - 1][0] == "id":
                call = word(j - 1).rsplit(".", 1)[-1]
                w = name_words(call)
                if len(w) > 1 and w[0] in ("set", "with", "use", "add"):
                    strength = name_strength(call)
        if strength:
            yield s, e, strength


def line_starts(text: str) -> list[int]:
    """Offsets at which the lines of a text start."""
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def cue_lines(text: str) -> list[int]:
    """Numbers, from 0, of the lines that may hold a credential. Lower-casing keeps the number of lines, not always the length."""
    if not text:
        return []
    low = text.lower()
    at: set[int] = set()
    for cue in (*_CUES, "://") if "@" in low else _CUES:
        i = low.find(cue)
        while i >= 0:
            at.add(i)
            i = low.find("\n", i)  # once a line is enough
            if i >= 0:
                i = low.find(cue, i)
    if not at:
        return []
    starts = line_starts(low)
    return sorted({bisect_right(starts, i) - 1 for i in at})


def find_credentials(text: str, path: str | None = None) -> list[tuple[int, int]]:
    """Spans of the credentials of a text, in order and without overlap; the parts of a split literal are spans of their own.

    Of a split literal only the first part tells where the credential starts: see :func:`credential_lines`.
    """
    return [(a, b) for a, b, _ in _scan(text, path)]


def _scan(text: str, path: str | None) -> list[tuple[int, int, bool]]:
    lines = cue_lines(text)
    if not lines:
        return []
    starts = line_starts(text)
    spans: dict[tuple[int, int], bool] = {}
    ext = _ext(path)
    code = ext in CODE

    def line_end(i: int) -> int:
        return starts[i + 1] - 1 if i + 1 < len(starts) else len(text)

    def add(a: int, b: int, first: bool = True) -> None:
        while b > a and text[b - 1].isspace():
            b -= 1
        while b > a and text[a].isspace():
            a += 1
        if b > a:
            spans.setdefault((a, b), first)

    for m in _KEYBLOCK.finditer(text):
        end, again = _KEYEND.search(text, m.end()), _KEYBLOCK.search(text, m.end())
        if end and not (again and again.start() < end.start()):
            stop = end.start()
        else:  # cut off: as far as the text goes on as armour
            stop = _ARMOUR.match(text, m.end()).end()
        between = text[m.end() : stop]
        if len(re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", between)) < 16 or _MASKED.search(between[:60]) or (code and _REGEX.search(between)):
            continue
        spans[(m.start(), m.end())] = True  # tells the line, stays unmasked
        spans[(m.end(), stop)] = False
    for i in lines:
        lo, hi = starts[i], line_end(i)
        line = text[lo:hi]
        if "PUBLIC KEY" in line:
            continue
        for m in _URL.finditer(line):
            v = m.group(2)
            if not (_REF.search(v) or _PLACE.match(v) or _MASKED.search(v) or re.search(r"[{}$%][A-Za-z_{(]", v) or (v.isdigit() and len(v) < 6)):
                add(lo + m.start(2), lo + m.end(2))
        for m in _HEADER.finditer(line):
            g = next(k for k in (1, 2, 3) if m.group(k))
            v = m.group(g)
            if is_secret(v, 2):
                add(lo + m.start(g), lo + m.end(g))
        for m in _USERPASS.finditer(line):
            if is_secret(m.group(2), 2):
                add(lo + m.start(2), lo + m.end(2))
        for m in _OPTION.finditer(line):
            if name_strength(m.group(1)) == 2:
                g = next((k for k in (2, 3, 4) if m.group(k)), 0)
                if g and is_secret(m.group(g), 2):
                    add(lo + m.start(g), lo + m.end(g))
        for rx in (_SQL, _PROSE):
            for m in rx.finditer(line):
                if is_secret(m.group(1), 2):
                    add(lo + m.start(1), lo + m.end(1))
        for m in _SLASHED.finditer(line):
            v = m.group(2).rstrip(".,;)")
            if looks_random(v) and is_secret(v, 1) and not v.startswith("//"):
                add(lo + m.start(2), lo + m.start(2) + len(v))
        for m in _XML_TAG.finditer(line):
            if name_strength(m.group(1)) == 2 and is_secret(m.group(2), 2):
                add(lo + m.start(2), lo + m.end(2))
        for m in _XML_ATTR.finditer(line):
            name, g = (m.group(1), 2) if m.group(1) is not None else (m.group(4), 3)
            if name_strength(name) == 2 and is_secret(m.group(g), 2):
                add(lo + m.start(g), lo + m.end(g))
        for m in _ISSUED.finditer(line):
            v = m.group(0)
            if not _MASKED.search(v) and not re.search(r"(.)\1{5,}", v):
                add(lo + m.start(), lo + m.end())
        if not code:
            for m in _INLINE_ENV.finditer(line):
                if name_strength(m.group(1)) == 2 and is_secret(m.group(2), 2):
                    add(lo + m.start(2), lo + m.end(2))
            m = _CONFIG.match(line)
            if m and (strength := name_strength(m.group(1))):
                v, at = m.group(2), lo + m.start(2)
                if v in ("|", ">", "|-", ">-", "|+", ">+", "\\", ""):  # the value stands on the following line
                    if i + 1 < len(starts) and strength == 2:
                        nxt = text[starts[i + 1] : line_end(i + 1)]
                        bare = nxt.strip().strip("'\"")
                        deeper = len(nxt) - len(nxt.lstrip()) > len(line) - len(line.lstrip())
                        if deeper and is_secret(bare, 2) and not _CONFIG.match(nxt):
                            p = starts[i + 1] + nxt.find(bare)
                            add(p, p + len(bare))
                else:
                    q = re.match(r"(['\"])(.*?)\1\s*[,;]?\s*(?:#.*)?$", v)
                    if q:
                        if is_secret(q.group(2), strength):
                            add(at + q.start(2), at + q.end(2))
                    else:
                        bare = re.split(r"\s+[#;]|,$", v)[0].strip().rstrip("\\").strip()
                        if is_secret(bare, strength) and "'" not in bare and '"' not in bare:
                            add(at, at + len(bare))
    for a, b, strength in _literal_candidates(text, 0, len(text)):
        whole, parts = text[a:b], [(a, b)]
        at = b + 1
        while (m := _GOES_ON.match(text, at)) and ("+" in text[at : m.start(1)] or text[at : m.start(1)].strip() in ("", "\\", ".") and "\n" in text[at : m.start(1)]):
            parts.append((m.start(2), m.end(2)))
            whole += m.group(2)
            at = m.end()
        if "PRIVATE KEY" in whole or _URL.search(whole) or not is_secret(_plain(whole), strength):
            continue
        for n, (x, y) in enumerate(parts):
            add(x, y, n == 0)
    out: list[tuple[int, int, bool]] = []
    for (a, b), first in sorted(spans.items(), key=lambda kv: (kv[0][0], -kv[0][1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, first))
        elif b > out[-1][1]:  # two readings of one place: all of both
            out[-1] = (out[-1][0], b, out[-1][2] or first)
    return out


def _plain(value: str) -> str:
    """A literal with the escapes that carry characters read."""
    if "\\" not in value:
        return value
    return _NUMBERED.sub(lambda m: chr(int(m.group(1) or m.group(2) or m.group(3), 16) if not m.group(4) else int(m.group(4), 8)) if int(m.group(1) or m.group(2) or m.group(3) or "0", 16) < 0x110000 else "?", value)


def credential_lines(text: str, path: str | None = None) -> list[int]:
    """The lines, from 1, on which a credential starts."""
    return sorted({text.count("\n", 0, a) + 1 for a, _, first in _scan(text, path) if first})


_PIECES = re.compile(r"(?P<number>\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,6}\}|[0-3][0-7]{2}))|(?P<keep>\\[\\\"'`nrtbfv0$\n]|[\r\n\t ]+)|(?P<plain>(?:[^\\\r\n\t ]|\\(?![xu0-3\\\"'`nrtbfv$\n]).|\\$)+|\\)", re.S)


def _masked(value: str) -> str:
    """A literal's characters masked. Escapes of quotes and line ends stay; a numbered character becomes an X of the same form."""
    out = []
    for m in _PIECES.finditer(value):
        piece = m.group(0)
        if m.lastgroup == "keep":
            out.append(piece)
        elif m.lastgroup == "plain":
            out.append(MASK)
        else:
            out.append("\\x58" if piece[1] == "x" else "\\130" if piece[1].isdigit() else "\\u{58}" if "{" in piece else "\\u0058")
    return "".join(out)


def redact(text: str, path: str | None = None) -> tuple[str, int]:
    """(the text with each credential's characters masked, the number of lines on which one starts); all else stays."""
    out, at, lines = [], 0, set()
    for a, b, first in _scan(text, path):
        if first:
            lines.add(text.count("\n", 0, a))
        if _KEYBLOCK.fullmatch(text[a:b]):
            continue
        out += [text[at:a], _masked(text[a:b])]
        at = b
    return "".join(out) + text[at:], len(lines)


def mask(text: str, path: str | None = None) -> str:
    """The text with each credential's characters masked."""
    return redact(text, path)[0]


def credential_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no), one row per line on which a credential starts. Null and empty contents give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, nos = [], []
            for cid, path, text in zip(batch["chunk_id"], batch["file_path"], batch["content"]):
                if text:
                    found = credential_lines(text, path)
                    ids += [cid] * len(found)
                    nos += found
            if ids:
                yield pd.DataFrame({"chunk_id": ids, "line_no": pd.array(nos, dtype="int64")})

    return chunks.select("chunk_id", "file_path", "content").where("chunk_id is not null").mapInPandas(run, "chunk_id string, line_no bigint").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content, n_masked) of the chunks that hold a credential, with only the credentials masked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cid, path, text in zip(batch["chunk_id"], batch["file_path"], batch["content"]):
                masked, n = redact(text, path) if text else ("", 0)
                if n:
                    rows.append((cid, masked, n))
            if rows:
                yield pd.DataFrame(rows, columns=["chunk_id", "content", "n_masked"])

    return chunks.select("chunk_id", "file_path", "content").where("chunk_id is not null").mapInPandas(run, "chunk_id string, content string, n_masked int").dropDuplicates(["chunk_id"])
