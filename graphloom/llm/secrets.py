"""Credentials embedded in source code and notes.

A text is searched for written-out values that would let their reader in: known
token shapes, private key blocks, passwords in URLs and connection strings,
authorisation headers, literals given to credential names, and values told in
prose.  Literals are decoded layer by layer (base64, hex, percent and escape
codes) until nothing decodes any more, binary layers are read by the grammar of
key containers, and what comes out is searched again; a hit inside masks the
enclosing literal.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame

MASK = "****"


class Finding(NamedTuple):
    start: int
    end: int
    kind: str


# Shapes of tokens whose issuer marks them.
TOKENS = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:"
    r"sk-(?:ant-|proj-|live-|test-)?[A-Za-z0-9_\-]{16,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}"
    r"|(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Z0-9])"
    r"|GOCSPX-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{35}|ya29\.[A-Za-z0-9_\-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|xapp-[A-Za-z0-9\-]{20,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_\-]{40,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{60,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|AGE-SECRET-KEY-1[A-Z0-9]{50,}"
    r"|[a-z]{2,8}[_\-](?:live|prod|secret)[_\-][A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r")"
)
# What the tokens above begin with or hold, in lower case.
TOKEN_SIGNS = ("sk-", "k_live_", "k_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "akia", "asia", "abia", "acca", "gocspx-", "aiza", "ya29.", "xox", "xapp-", "npm_", "pypi-", "hf_", "dop_v1_", "sg.", "age-secret-key-1", "live", "prod", "secret", "eyj")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:[^-]|-(?!----))*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?=[\"'`]|\Z))")
PPK = re.compile(r"PuTTY-User-Key-File-\d: [\w-]+\s+Encryption: [\w-]+[\s\S]*?Private-Lines: \d+\s+(?:[A-Za-z0-9+/=]+\s*)+(?:Private-(?:MAC|Hash): [0-9a-f]+)?")
URL_LOGIN = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]{1,20}://(?P<user>[^\s:/@\"'`<>]*):(?P<value>[^\s/@\"'`]+)@(?=[\w\[$({.-])")
CONNECTION = re.compile(r"(?i)\b(?:AccountKey|SharedAccessKey|SharedSecret|SharedAccessSignature|Password|Pwd|PassPhrase|ClientSecret|ApiKey|AuthToken|Access[ _]?Key|Secret[ _]?Key)\s?=\s?(?P<value>[^\s;\"'`&(){}\[\]]+)")
COMMAND = re.compile(r"(?<![\w-])(?:-u|--user|--proxy-user)[ =]+[\"']?[\w.@+-]+:(?P<value>[^\s\"'`]+)|(?<![\w-])--(?:password|passwd|pass|token|api-key|secret|access-token)[ =]+[\"']?(?P<value2>[^\s\"'`]+)|\bsshpass\s+-p\s*[\"']?(?P<value3>[^\s\"'`]+)")
HEADER = re.compile(r"(?i)\b(?P<scheme>Bearer|Basic|Token|Digest)\s+(?P<value>[A-Za-z0-9._~+/=\-]{8,})")
QUERY = re.compile(r"(?i)[?&](?:access_token|auth_token|token|api_?key|apikey|key|secret|client_secret|sig|signature|password|passwd|pwd)=(?P<value>[^\s&\"'`#<>{}$]{8,})")
PROSE = re.compile(
    r"(?i)\b(?P<noun>pass\s?word|pass\s?phrase|passwd|pwd|passcode|secret(?: key)?|api[ -]?key|access[ -]?key|(?:auth|access|bearer|api|service|refresh)?[ -]?token|private key|credentials?|kennwort|passwort|mot de passe|(?<=used )key|(?<=with )key|(?<=the )key)"
    r"(?:\s+(?:for|of|to)\s+[\w./\-]+(?:\s+[\w./\-]+)?)?(?:\s*(?:=|:|->)\s*|\s+(?:is|was|are|ist|war|est|became|now|set to|changed to|reset to|rotated to)(?:\s+(?:now|still|set to|currently))?\s+|\s+)"
    r"(?P<quote>[`\"']?)(?P<value>[^\s`\"',;()<>]{6,})(?P=quote)"
)
LITERAL = re.compile(r"\"(?P<d>(?:\\.|[^\"\\\n])*)\"|'(?P<s>(?:\\.|[^'\\\n])*)'|`(?P<b>(?:\\[\s\S]|[^`\\])*)`")
CHAIN = re.compile(r"(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')(?:\s*(?:\+|\.\.|\.|&|\\\n)\s*(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))+|(?<=\()\s*(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')(?:\s*\n\s*(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))+")
CONCAT = re.compile(r"\b(?:concat!|concat|CONCAT|[Jj]oin)\s*\(\s*\[?\s*(?P<args>(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')(?:\s*,\s*(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))+)")
#: A name and the sign that gives it the literal that follows.
LEFT = re.compile(r"(?:(?P<q>[\"'`])(?P<quoted>[\w .\-]{1,60})(?P=q)|(?P<name>[A-Za-z_$][\w$.\-]{0,60}))[ \t]*[\])]?[ \t]*(?:\??[ \t]*:[ \t]*[\w&'<>\[\]|. ]{1,40}?)?\s*(?:=>|:=|==|[=:]|,|\()\s*(?:[a-z]{0,2}(?=\Z)|\(|b?r?#*|String::from\(|str\()?\s*\Z")
LINE = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?(?P<q>[\"']?)(?P<name>[A-Za-z_][\w.\-]*)(?P=q)[ \t]*[=:][ \t]*(?P<value>[^\s\"'`#][^\n]*?)[ \t]*,?[ \t]*(?:[ \t]#[^\n]*)?$")
INNER = re.compile(r"(?<![\w$.\-])(?P<name>[A-Za-z_][\w.\-]{2,60})=(?P<value>[^\s\"'`;&|]{6,})")
SAID = re.compile(r"(?<![\w$.\-])(?P<name>[A-Za-z_][\w.\-]{2,60})\s*[:=]\s*(?P<value>[^\s\"'`;,(){}\[\]<>]{6,}+)(?!\s*[:=])")
LOGIN_PROSE = re.compile(r"(?i)\b(?:log(?:ged|ging)?[ -]?(?:in|on)|sign(?:ed|ing)?[ -]?in|connect(?:ed)?|credentials?|account|user(?:name)?)\s*(?:as|with|are|is|:|=)?\s+[`\"']?[\w.@+\-]+[`\"']?\s*(?:/|:|,?\s+(?:and|with|using)\s+(?:the\s+)?(?:password|passphrase|pass)?)\s*[`\"']?(?P<value>[^\s`\"',;()<>]{6,})")
COMMENT = re.compile(r"(?://|#|/\*|^\s*\*|--|<!--)")
LOGIN_CALL = re.compile(r"(?i)(?:\b|_)(?:log_?in|sign_?in|authenticate|basic_?auth|with_?credentials|set_?credentials|auth)\s*\(\s*(?:[\"'`][^\"'`\n]*[\"'`]|[\w.]+)\s*,\s*\Z|\bauth\s*=\s*\(\s*[\"'][^\"'\n]*[\"']\s*,\s*\Z")

# Words that make a name the name of a credential, and words that take it back.
PASSWORDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "passwort", "kennwort", "pw", "credential", "credentials", "creds", "cred"}
PASS_ENDINGS = ("password", "passwd", "pwd", "passphrase", "pgpass", "dbpass", "userpass")
SECRETS = {"secret", "token", "auth", "apikey", "accesskey", "secretkey", "privatekey", "authtoken", "authkey", "psk", "bearer", "authorization", "jwt", "pat", "signature"}
KEY_WORDS = {"api", "access", "secret", "private", "encryption", "encrypt", "signing", "sign", "deploy", "account", "auth", "master", "service", "webhook", "shared", "storage", "client", "session", "ssh", "hmac", "jwt", "app", "admin", "crypto", "license", "root", "aes", "rsa", "pgp", "gpg", "stripe", "aws", "azure", "gcp", "data", "db", "server"}
NO_TOKEN = {"next", "page", "cursor", "continuation", "sync", "resume", "last", "previous", "prev", "start", "end", "csrf", "xsrf", "lexer", "parser", "syntax", "eof", "public", "pub", "cache", "label", "primary", "foreign", "sort", "partition", "idempotency", "i18n", "translation", "cancellation", "cancel"}
SURE_PASSWORDS = {"password", "passwd", "pwd", "passphrase", "passwort", "kennwort"}
UNSURE_BEFORE = {"is", "has", "no", "show", "hide", "reset", "forgot", "forgotten", "change", "confirm", "label", "test", "mock", "fake", "input", "type", "field", "grant"}
PLAIN_WORDS = {"string", "number", "boolean", "object", "required", "optional", "invalid", "missing", "hidden", "visible", "plain", "plaintext", "hashed", "encrypted", "salted", "masked", "redacted", "bcrypt", "scrypt", "argon", "pbkdf", "prompt", "prompted", "keyboard", "interactive", "manual", "reset", "forgot", "forgotten", "change", "changed", "changeme", "update", "updated", "expired", "disabled", "enabled", "unknown", "undefined", "default", "external", "keyring", "keychain", "keyvault", "manager", "managed", "vault", "secret", "secrets", "password", "passwords", "passphrase", "passwort", "kennwort", "passwd", "credential", "credentials", "token", "tokens", "login", "logins", "username", "userpass", "environment", "config", "configured", "settings", "example", "sample", "placeholder", "dummy", "testing", "nothing", "stored", "generated", "random", "inherit", "provided", "supplied", "mypassword", "yourpassword", "dbpassword", "userpassword", "newpassword", "oldpassword", "currentpassword", "confirmpassword", "adminpassword", "testpassword", "rootpassword", "notset", "unset", "ignored", "removed", "deleted", "omitted", "blank", "empty", "strong", "weaker", "medium", "minimum", "length", "policy", "rotate", "rotated", "rotation"}
PLACEHOLDERS = re.compile(
    r"(?i)^(?:<[^>]*>?|\[[^\]]*\]|\$\{.*|\$\(.*|\$[A-Za-z_]\w*|\{\{.*|\{[\w. ]*\}|%\w|%\(\w+\)s|%[A-Z_]+%|@[\w.]+@|#\{.*|[*•.\-_xX#?]+|"
    r"(?:change|replace|fill|set|insert|enter|put)[ _\-]?(?:me|it|this|here|in|your.*|before.*)?(?:[ _\-].*)?|your[ _\-].*|my[ _\-]?(?:password|secret|token|key|api[ _\-]?key)|(?:some|any|the|a|new|old|no|default|test|fake|dummy|sample|example|mock|temp|invalid|wrong|bad|expired|not[ _\-]?a)[ _\-]?(?:real[ _\-]?)?(?:password|passwd|pass|secret|token|key|credentials?|value)|"
    r"todo|fixme|tbd|none|null|nil|undefined|true|false|yes|no|empty|required|optional|hidden|redacted|masked|removed|secret|password|passwd|passphrase|token|key|string|str|text|number|bool(?:ean)?|object|any|unknown|example|sample|dummy|placeholder|n/?a|foo|bar|baz|foobar|vault|env|file|prompt|input|admin|root|user|username|test|bearer|basic|oauth2?|credentials?|api[ _\-]?key)$"
)
PLACE_INSIDE = re.compile(r"(?i)example|placeholder|change[ _\-]?me|replace[ _\-]?(?:me|this|with)|your[ _\-](?:\w+[ _\-])*(?:key|token|secret|password|pass|value)|\*{3,}|•{3,}|x{6,}|\.{3,}$|redacted|<[\w \-]+>|\$\{[^}]*\}|\{\{|insert[ _\-]|dummy|notreal|fakekey|0{12,}|1234567890abcdef|^\{.*\}$")
LOOKUP = re.compile(r"^(?:process\.env|os\.environ|os\.getenv|env[.\[(:]|std::env|getenv|config[.\[(]|settings[.\[]|secrets?[.\[]|vault[:/.]|ssm:|arn:|aws:|gcp:|projects/|file:|op://|ref\+|!(?:Ref|Sub|vault|secret)|\$|@|kv:|keyvault|\w+\([^)]*\)$)")
_NUMBER = re.compile(r"^[\d.,_:\-+ ]+(?:ms|s|m|h|d|kb|mb|gb|%)?$", re.I)
_PATH = re.compile(r"^(?:\.{0,2}/)?[\w.\-]+(?:/[\w.\-]+)+/?$|^/[\w.\-]*$")
_DOTTED = re.compile(r"^[a-zA-Z][a-zA-Z_]*(?:\.[a-zA-Z][a-zA-Z_]*)+$|^[a-z][a-z_]*(?::[\w\-]+)+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_HASHED = re.compile(r"^(?:sha\d{1,3}[-:]|md5[-:]|\$2[aby]\$|\$argon2|\$\d\$|pbkdf2|\{SSHA|data:|ssh-(?:rsa|ed25519|dss) |ecdsa-|-----BEGIN (?:[A-Z]+ )*(?:PUBLIC KEY|CERTIFICATE))")


def name_words(name: str) -> list[str]:
    """The words of an identifier, in lower case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def name_kind(name: str) -> str | None:
    """``password``, ``secret`` or None: what a name says its value is.

    The last word decides: a ``tokenCount``, ``passwordField`` or ``secretName``
    is no credential.
    """
    words = [w for w in name_words(name) if not w.isdigit()]
    if not words:
        return None
    last, before = words[-1], set(words[:-1])
    joined = "".join(words[-2:])
    if last in PASSWORDS or last.endswith(PASS_ENDINGS):
        return None if last == "pass" and len(words) > 1 and words[-2] in {"render", "first", "second", "single", "multi", "by"} else "password"
    if before & NO_TOKEN or any(last == w + e for w in NO_TOKEN for e in ("token", "key")):
        return None
    if last in SECRETS or joined in SECRETS:
        return None if last in {"signature"} else "secret"
    if last in {"key", "keys"} and (before & KEY_WORDS):
        return "secret"
    # names without borders between their words: DEPLOYKEY, webhooksecret
    if last.endswith(("secret", "token", "credential", "credentials")) or any(last == w + "key" for w in KEY_WORDS):
        return "secret"
    return None


def sure_name(name: str) -> bool:
    """Whether a name can only be a password's (``password``, ``DB_PASSWORD``)."""
    words = [w for w in name_words(name) if not w.isdigit()]
    return bool(words) and (words[-1] in SURE_PASSWORDS or words[-1].endswith(PASS_ENDINGS)) and not set(words[:-1]) & UNSURE_BEFORE


def _varied(v: str) -> bool:
    kinds = bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\s]", v))
    return kinds >= 2 and len(set(v)) >= min(6, len(v) * 0.4)


def is_placeholder(v: str) -> bool:
    return bool(PLACEHOLDERS.match(v) or PLACE_INSIDE.search(v) or len(set(v)) <= 2)


def plausible(value: str, kind: str, sure: bool = False) -> bool:
    """Whether a literal given to a credential name is a value, not an empty or
    masked one, a placeholder, a look-up, a name, a public key or a hash.

    ``sure``: the name leaves no doubt, so that one plain word is a value, too.
    """
    v = value.strip()
    if len(v) < 4 or is_placeholder(v) or LOOKUP.match(v) or _HASHED.match(v):
        return False
    if kind == "password":
        if " " in v and not re.search(r"\d", v):
            return False
        if sure and re.fullmatch(r"[a-z]{6,}", v):
            return v not in PLAIN_WORDS
        # a password may be plain words; a single lower-case word is a field's name more often
        return bool(re.search(r"[\d\W_]|[a-z][A-Z]|[A-Z].*[a-z]", v)) and not _DOTTED.match(v) and not (re.fullmatch(r"[A-Z][A-Z_]+|[a-z]+(?:_[a-z]+)+", v)) and not _NUMBERISH.match(v)
    if len(v) < 8 or " " in v or _NUMBER.match(v) or _DOTTED.match(v) or _UUID.match(v) and kind != "secret":
        return False
    if _PATH.match(v) and len(max(re.split(r"[/.]", v), key=len)) < 16:
        return False
    if re.match(r"^[a-z][a-z0-9+.\-]*://", v):
        return False
    return _varied(v) and bool(re.search(r"\d", v) or len(v) >= 20 and re.search(r"[a-z][A-Z]|[A-Z][a-z]", v))


_NUMBERISH = re.compile(r"^(?:\d+(?:\.\d+)?\s*(?:ms|s|m|h|d|min|sec|days?|chars?)|\d{1,3})$", re.I)


def _strong(v: str) -> bool:
    """Prose gives a value no quotes: it must look like no word of a language."""
    v = v.rstrip(".,:!?")
    if len(v) < 6 or is_placeholder(v) or LOOKUP.match(v) or _UUID.match(v) or _HASHED.match(v) or re.match(r"^[a-z]+://", v):
        return False
    if re.fullmatch(r"[A-Za-z]+(?:['’\-][A-Za-z]+)*|[A-Za-z]+(?:_[A-Za-z]+)*(?:\(\))?|[a-z]+(?:[A-Z][a-z]+)+(?:\(\))?|[\d.,%]+|v?\d+(?:\.\d+)+", v) and not (len(v) >= 8 and re.fullmatch(r"[A-Za-z]+", v) and sum(map(str.isupper, v)) >= 2 and re.search(r"[a-z][A-Z]+[a-z]*[A-Z]|[A-Z]{2,}[a-z]+[A-Z]", v)):
        return False
    if _PATH.match(v) and not re.search(r"[A-Za-z0-9+/=]{24,}", v):
        return False
    return bool(re.search(r"\d", v) or re.search(r"[^\w.\-/]", v) or _varied(v) and re.search(r"[a-z][A-Z]", v))


# ---------------------------------------------------------------- decoding


def _printable(raw: bytes) -> str | None:
    try:
        t = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return t if t and sum(c.isprintable() or c in "\r\n\t" for c in t) >= 0.97 * len(t) else None


def _tlv(raw: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the DER element at ``at``."""
    if at + 2 > len(raw):
        return None
    n, at2 = raw[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at2 + k > len(raw):
            return None
        n, at2 = int.from_bytes(raw[at2 : at2 + k], "big"), at2 + k
    return (raw[at], at2, at2 + n) if at2 + n <= len(raw) else None


_OPENSSH = b"openssh-key-v1\0"


def _is_openssh(raw: bytes) -> bool:
    """Magic, cipher, derivation and its options, number of keys, as many public
    keys, and the private section: two equal check numbers and a key's type
    where it isn't encrypted, whole cipher blocks where it is."""
    at = len(_OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(raw[at : at + 4], "big") if at + 4 <= len(raw) else len(raw)
        if at + 4 + n > len(raw):
            return None
        at += 4 + n
        return raw[at - n : at]

    head = [field(), field(), field()]
    if None in head or not head[0] or not head[1] or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= len(raw) // 8:
        return False
    if any(not field() for _ in range(keys)):
        return False
    private = field()
    if not private or len(raw) - at > 16:
        return False
    if head[0] != b"none":
        return len(private) % 8 == 0
    n = int.from_bytes(private[8:12], "big")
    return private[:4] == private[4:8] and 4 <= n <= len(private) - 12 and private[12 : 12 + n].isascii()


def is_key_container(raw: bytes) -> bool:
    """Whether bytes are a private key by their grammar: PKCS#8 (plain or
    encrypted), PKCS#1, SEC1, PKCS#12 or OpenSSH; public keys and certificates
    are not."""
    if raw.startswith(_OPENSSH):
        return _is_openssh(raw)
    top = _tlv(raw, 0)
    if not top or top[0] != 0x30 or top[2] < len(raw) - 2 or len(raw) < 24:
        return False
    parts = []
    at = top[1]
    while at < top[2] and len(parts) < 12:
        e = _tlv(raw, at)
        if not e:
            return False
        parts.append((e[0], raw[e[1] : e[2]]))
        at = e[2]
    tags = [t for t, _ in parts]
    if tags[:3] == [0x02, 0x30, 0x04] and parts[1][1][:1] == b"\x06":
        return True  # PKCS#8: version, algorithm, key
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1: version and eight numbers
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01":
        return True  # SEC1: version 1, key
    if tags[:2] == [0x30, 0x04] and len(tags) == 2 and parts[0][1][:2] == b"\x06\x09":
        return True  # encrypted PKCS#8
    return tags[:2] == [0x02, 0x30] and parts[0][1] == b"\x03" and b"\x2a\x86\x48\x86\xf7\x0d\x01\x07" in parts[1][1][:16]


_B64 = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_HEX = re.compile(r"(?:0x)?(?:[0-9a-fA-F]{2}[:\s]?){12,}")
#: Encoded runs as they stand in a text: base64 over any number of lines (the
#: lines after the first hold nothing else), hex with or without separators, and
#: tokens with percent or escape codes.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{12,}={0,2}(?:[ \t]*\\?\r?\n[ \t]*(?:(?:#|//|\*|>|\|)[ \t]*)?(?:[A-Za-z0-9+/_\-]+={0,2}|={1,2})(?=[ \t]*(?:\\?\r?\n|[\"'`]|\Z)))*")
_HEX_RUN = re.compile(r"(?<![0-9A-Za-z])(?:0x)?[0-9a-fA-F]{2}(?:(?:[:\s]|\s*\n[ \t]*)?[0-9a-fA-F]{2}){11,}(?![0-9A-Za-z])")
_CODE_RUN = re.compile(r"(?:[\w.~+\-]*(?:%[0-9A-Fa-f]{2}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\[0-7]{3}|&#x?[0-9a-fA-F]+;))+[\w.~+\-]*")
_WRAP = re.compile(r"[ \t]*\\?\r?\n[ \t]*(?:(?:#|//|\*|>|\|)[ \t]*)?")
_ESC = re.compile(r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\[0-7]{3}|&#x?[0-9a-fA-F]+;")


#: Codes of the signs that open codes, any number deep: an escaped backslash, percent sign or ampersand.
_DEEP = ((re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})"), "%"), (re.compile(r"\\(?:x5[cC]|u005[cC]|u\{5[cC]\}|134)+(?=[xu0-7])"), "\\"), (re.compile(r"&(?:#38;|#x26;|amp;)+(?=#)"), "&"))


def _flat(v: str) -> str:
    """Codes of codes as plain codes, so that a text coded a thousand times over
    is one layer."""
    for rx, sign in _DEEP:
        v = rx.sub(lambda _, s=sign: s, v)
    return v


def _unescape(v: str) -> str:
    def one(m: re.Match) -> str:
        s = m[0]
        if s.startswith("&#"):
            return chr(int(s[3:-1], 16) if s[2] in "xX" else int(re.sub(r"\D", "", s) or 0))
        return chr(int(s[1:], 8) if s[1].isdigit() else int(s[2:].strip("{}"), 16))

    try:
        return _ESC.sub(one, v)
    except (ValueError, OverflowError):
        return v


def layers(v: str) -> Iterator[str | bytes]:
    """What a literal says one layer down: text, or bytes that are no text."""
    flat = _flat(v) if "%25" in v or "\\" in v or "&" in v else v
    if _ESC.search(flat):
        un = _unescape(flat)
        if un != v:
            yield un
    if re.search(r"%[0-9A-Fa-f]{2}", flat):
        un = unquote(flat)
        if un != v:
            yield un
    s = re.sub(r"\\n|\s+", "", v)
    if _HEX.fullmatch(v.strip()):
        h = re.sub(r"[^0-9a-fA-F]", "", v.strip().removeprefix("0x"))
        if len(h) % 2 == 0:
            raw = bytes.fromhex(h)
            yield _printable(raw) or raw
    elif _B64.fullmatch(s):
        std = s.replace("-", "+").replace("_", "/").rstrip("=")
        try:
            raw = base64.b64decode(std + "=" * (-len(std) % 4))
        except (binascii.Error, ValueError):
            return
        yield _printable(raw) or raw


#: Tells whether a credential lies below a literal of a name's kind.
Deep = Callable[[str, "str | None"], bool]


def encoded_secret(v: str, kind: str | None) -> bool:
    """Whether a credential shows up in any layer below a literal.

    A worklist instead of recursion: every layer is searched as a text, and the
    encoded literals and runs in it are decoded in turn.  A layer is shorter than
    what held it and no text is decoded twice, so the length of the text bounds
    the work, and no depth is set.
    """
    todo: list[tuple[str, str | None, int]] = [(v, kind, 0)]
    seen = {(v, kind)}
    while todo:
        at, k, depth = todo.pop()
        for low in layers(at):
            if isinstance(low, bytes):
                if is_key_container(low):
                    return True
                continue
            if depth and k and plausible(low, k) or _direct(low):
                return True

            def later(x: str, kx: str | None, below: int = depth + 1) -> bool:
                if (x, kx) not in seen:
                    seen.add((x, kx))
                    todo.append((x, kx, below))
                return False

            if _find(low, "text", later):
                return True
            if len(low) >= 8:
                later(low, k)
    return False


def _says(v: str) -> bool:
    """Whether base64 may say something: its first bytes are text, or those of a
    key container.  Spares most names and paths a closer look."""
    try:
        raw = base64.b64decode(v[:24].replace("-", "+").replace("_", "/").rstrip("=")[: len(v[:24].rstrip("=")) // 4 * 4])
    except (binascii.Error, ValueError):
        return False
    return raw[:1] == b"0" or raw.startswith((b"openssh-key", b"PuTTY-User")) or not raw.translate(None, _TEXT_BYTES)


_TEXT_BYTES = bytes([9, 10, 13, *range(32, 127), *range(128, 256)])


def _encoded_runs(text: str, deep: Deep, add) -> None:
    """Encoded runs wherever they stand, in literals or outside them."""
    for m in _RUN.finditer(text):
        whole = m[0]
        if "\n" not in whole:
            if len(whole) >= 16 and _says(whole) and deep(whole, None):
                add(m.start(), m.end(), "encoded")
            continue
        # lines and where they begin; a run may hold a word before or after the wrapped value
        lines, at = [], 0
        for w in _WRAP.finditer(whole):
            lines.append((at, w.start()))
            at = w.end()
        lines.append((at, len(whole)))
        i, tried, last = 0, 0, len(lines) - 1
        while i <= last:
            a, b = lines[i]
            if not _says(whole[a:b]):
                i += 1
                continue
            ends = [i]
            if i >= tried:
                # the wrapped value ends with padding, with the run or a line before, or with the first line of another width
                width = lines[min(i + 1, last)][1] - lines[min(i + 1, last)][0]
                full = next((j for j in range(i, last) if whole[lines[j][1] - 1] == "="), last)
                even = next((j for j in range(i + 1, last) if lines[j][1] - lines[j][0] != width), last)
                ends, tried = [full, last, last - 1, even, even - 1, i], even
            for j in dict.fromkeys(ends):
                v = "".join(whole[x:y] for x, y in lines[i : j + 1])
                if len(v) >= 16 and deep(v, None):
                    add(m.start() + a, m.start() + lines[j][1], "encoded")
                    i = j
                    break
            i += 1
    for m in _HEX_RUN.finditer(text):
        if deep(re.sub(r"[:\s]", "", m[0]), None):
            add(m.start(), m.end(), "encoded")
    if "%" in text or "\\" in text or "&#" in text:
        for m in _CODE_RUN.finditer(text):
            if len(m[0]) >= 9 and deep(m[0], None):
                add(m.start(), m.end(), "encoded")


def _direct(v: str) -> bool:
    """A decoded text that is a credential as a whole."""
    m = TOKENS.fullmatch(v.strip())
    return bool(m and not is_placeholder(v)) or bool(PEM.search(v)) or bool(PPK.search(v))


# ---------------------------------------------------------------- the search

def _stems(words: set[str]) -> tuple[str, ...]:
    """The fewest parts one of which every word holds."""
    kept: list[str] = []
    for w in sorted(words, key=lambda w: (len(w), w)):
        if not any(k in w for k in kept):
            kept.append(w)
    return tuple(kept)


#: What a line must hold to deserve a closer look: part of any name of a credential, or a sign of one of the other shapes.
CUE_WORDS = _stems({*PASSWORDS, *PASS_ENDINGS, *SECRETS, "key", "token", "secret", "credential"} - {"pat"}) + ("://", "begin", "basic", "digest", "-u", "\\x", "\\u", "&#", "sk-", "xox", "eyj", "sig=")
_CUE_LOGIN = re.compile(r"log(?:ged|ging)?[ _-]?[io]n|sign(?:ed|ing)?[ _-]?in")
_CUE_PAT = re.compile(r"[Pp][Aa][Tt](?![a-z])")
#: Codes that are rare enough to be looked for only where their sign stands.
_CUE_CODES = (("%", re.compile(r"(?:%[0-9A-Fa-f]{2}){3}")), ("\\", re.compile(r"(?:\\[0-7]{3}){3}")), ("SG.", re.compile(r"\bSG\.[A-Za-z0-9_\-]{16}")))
#: Characters of encoded runs as ``x``, and hex digits as ``h`` with their separators as ``:``; all others as blanks.
_RUN_SIGNS = bytes(120 if chr(i) in "+/_-" or i < 128 and chr(i).isalnum() else 32 for i in range(256))
_HEX_SIGNS = bytes(104 if chr(i) in "0123456789abcdefABCDEF" else 58 if chr(i) in ": \t\n\r\v\f" else 32 for i in range(256))
_LONG_RUN, _LONG_HEX = b"x" * 20, b"hh:" * 11 + b"hh"


def _cue_runs(text: str) -> Iterator[tuple[int, int]]:
    """Where runs stand that may be encoded: 20 characters of base64, or hex pairs,
    percent and octal codes in a row.  The text is mapped to signs of the same
    length, in which a plain search for a run is fast."""
    flat = text.encode("latin-1", "replace")
    for table, run in ((_RUN_SIGNS, _LONG_RUN), (_HEX_SIGNS, _LONG_HEX)):
        signs = flat.translate(table)
        at = signs.find(run)
        while at >= 0:
            yield at, at + len(run)
            at = signs.find(run, at + len(run))
    for sign, rx in _CUE_CODES:
        if sign in text:
            for m in rx.finditer(text):
                yield m.span()


def has_cue(text: str) -> bool:
    low = text.lower()
    if any(w in low for w in CUE_WORDS):
        return True
    if ("log" in low or "sign" in low) and _CUE_LOGIN.search(low):
        return True
    if "pat" in low and _CUE_PAT.search(text):
        return True
    if ("connect" in low or "account" in low or "user" in low) and LOGIN_PROSE.search(text):
        return True
    return next(_cue_runs(text), None) is not None


#: How a line ends whose value may stand on the next, and how such a next line begins.
_OPEN = re.compile(r"(?:[=:(,\[{+\\|>&.]|\b(?:return|is|was|are))[ \t\r]*\Z")
_GOES_ON = re.compile(r"[ \t]*(?:[=:(,+.]|[\"'`])")


def _cue_lines(text: str) -> set[int] | None:
    """Numbers of the lines with a cue, found by looking through the text as a
    whole; None where letters change their number in lower case."""
    low = text.lower()
    if len(low) != len(text):
        return None
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    found: set[int] = set()
    for w in CUE_WORDS:
        at = low.find(w)
        while at >= 0:
            n = bisect_right(starts, at)
            found.add(n - 1)
            # one hit a line is enough
            at = low.find(w, starts[n]) if n < len(starts) else -1
    rest = []
    if "log" in low or "sign" in low:
        rest.append((_CUE_LOGIN, low))
    if "pat" in low:
        rest.append((_CUE_PAT, text))
    if "connect" in low or "account" in low or "user" in low:
        rest.append((LOGIN_PROSE, text))
    for a, b in (*(m.span() for rx, where in rest for m in rx.finditer(where)), *_cue_runs(text)):
        found.update(range(bisect_right(starts, a) - 1, bisect_right(starts, b - 1)))
    return found


def _lines(text: str, lang: str = "text") -> list[tuple[int, int]]:
    """Stretches worth a closer look: lines with a cue, neighbours as one.

    A line that leaves an assignment, a call, a list or a sentence open brings the
    next one along, and so on; blank lines between them count for nothing.  A
    literal over several lines is taken whole.  In prose every line with a cue
    brings the next one.
    """
    out: list[tuple[int, int]] = []
    s, more = 0, False
    whole = _blocks(text)
    at = 0
    cues = _cue_lines(text)
    if cues is not None and not cues:
        return out
    for n, line in enumerate(text.split("\n")):
        e = s + len(line)
        cue = has_cue(line) if cues is None else n in cues
        if not cue and more and not line.strip():
            s = e + 1
            continue
        on = more and (more == "open" or _GOES_ON.match(line) is not None)
        if cue or on:
            b, f = s, e
            if on and out:
                b = out[-1][1] + 1
            while at < len(whole) and whole[at][1] <= s:
                at += 1
            if at < len(whole) and whole[at][0] < e:
                k = at
                while k < len(whole) and whole[k][0] < e:
                    k += 1
                # a literal that began on an earlier line is looked at from its name on
                b, f = min(b, text.rfind("\n", 0, whole[at][0]) + 1), max(f, whole[k - 1][1])
            if out and b <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(f, out[-1][1]))
            else:
                out.append((b, f))
            more = "open" if cue and lang == "text" or _OPEN.search(line) else "maybe" if cue else False
        else:
            more = False
        s = e + 1
    return out


_BLOCK = re.compile(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`")


#: What stands before a literal in three quotes that is a value, no documentation.
_GIVEN = re.compile(r"(?:=|\(|,|[\"']\s*:)\s*[A-Za-z]{0,2}\Z")
SCALAR = re.compile(r"(?m)^(?P<in>[ \t]*)(?:-[ \t]+)?(?P<q>[\"']?)(?P<name>[A-Za-z_][\w.\-]*)(?P=q):[ \t]*[|>][+\-\d]*[ \t]*(?P<value>(?:\n[ \t]*(?=\n|\Z)|\n(?P=in)[ \t]+\S[^\n]*)+)")


def _blocks(text: str) -> list[tuple[int, int]]:
    """Literals over several lines."""
    if "`" not in text and '"""' not in text and "'''" not in text:
        return []
    return [m.span() for m in _BLOCK.finditer(text) if "\n" in m[0]]


def find(text: str, lang: str = "text") -> list[Finding]:
    """Credentials of a text: where their values begin and end.

    ``lang``: ``env`` and ``yaml`` take unquoted values; ``text`` is prose.
    """
    return _find(text, lang, encoded_secret)


def _find(text: str, lang: str, deep: Deep) -> list[Finding]:
    got: list[Finding] = []

    def add(start: int, end: int, kind: str) -> None:
        got.append(Finding(start, end, kind))

    for m in PEM.finditer(text) if "PRIVATE KEY" in text else ():
        if len(re.findall(r"[A-Za-z0-9+/=]", re.sub(r"\\[nrt]", "", m["body"]))) >= 32:
            add(m.start(), m.end(), "private-key")
    for m in PPK.finditer(text) if "PuTTY-User-Key-File" in text else ():
        add(m.start(), m.end(), "private-key")
    for s, e in _lines(text, lang):
        _search(text, s, e, lang, deep, add)
    _encoded_runs(text, deep, add)
    for s, e in _blocks(text):
        q, left = text[s : s + 3], _left(text, s)
        if q in ('"""', "'''") and _GIVEN.search(left):
            v = text[s + 3 : e - 3]
            _literal(v.strip(), s + 3 + len(v) - len(v.lstrip()), re.sub(r"[A-Za-z]{1,2}\Z", "", left), deep, add)
    for m in SCALAR.finditer(text) if lang in ("env", "yaml") else ():
        kind, v = name_kind(m["name"]), m["value"].strip()
        if kind and plausible(v if kind == "password" else re.sub(r"\s+", "", v), kind, sure_name(m["name"])):
            a = m.start("value") + len(m["value"]) - len(m["value"].lstrip())
            add(a, a + len(v), "assignment")
    if " +" in text or "concat" in text or "\n" in text and '"\n' in text:
        for m in (*CHAIN.finditer(text), *CONCAT.finditer(text)):
            _joined(text, m, deep, add)
    return _merged(got)


def _search(text: str, s: int, e: int, lang: str, deep: Deep, add) -> None:
    part = text[s:e]
    low = part.lower()
    has = lambda *words: any(w in low for w in words)
    for m in TOKENS.finditer(part) if has(*TOKEN_SIGNS) else ():
        if not is_placeholder(m[0]) and _varied(m[0]):
            add(s + m.start(), s + m.end(), "token")
    for rx, kind, sign in ((URL_LOGIN, "url-password", "://"), (CONNECTION, "connection-string", ";"), (QUERY, "query-parameter", "=")):
        for m in rx.finditer(part) if sign in part else ():
            v = m["value"]
            if kind == "url-password" and (is_placeholder(v) or LOOKUP.match(v)):
                continue
            if kind == "connection-string" and not (part[: m.start()].rstrip()[-1:] == ";" or part[m.start() - 1 : m.start()] in ("'", '"', "`") and part[m.end() : m.end() + 1] == ";"):
                continue
            if kind != "url-password" and not plausible(v, "password" if kind == "connection-string" else "secret"):
                continue
            add(s + m.start("value"), s + m.end("value"), kind)
    for m in COMMAND.finditer(part) if has("-u", "--", "sshpass") else ():
        g = next(n for n in ("value", "value2", "value3") if m[n])
        if not is_placeholder(m[g]) and not LOOKUP.match(m[g]):
            add(s + m.start(g), s + m.end(g), "command-line")
    for m in HEADER.finditer(part) if has("bearer", "basic", "token", "digest") else ():
        v = m["value"].rstrip(".")
        if m["scheme"].lower() == "basic":
            pair = next((x for x in layers(v) if isinstance(x, str)), None) if len(v) >= 8 else None
            if pair is None and len(v) >= 8:
                try:
                    pair = _printable(base64.b64decode(v + "=" * (-len(v) % 4)))
                except (binascii.Error, ValueError):
                    pair = None
            user, colon, secret = (pair or "").partition(":")
            if colon and secret and not is_placeholder(secret):
                add(s + m.start("value"), s + m.start("value") + len(v), "basic-auth")
        elif len(v) >= 12 and not is_placeholder(v) and not LOOKUP.match(v) and _varied(v) and re.search(r"\d", v):
            add(s + m.start("value"), s + m.start("value") + len(v), "header")
    for m in LITERAL.finditer(part):
        g = m.lastgroup
        v, a = m[g], s + m.start(g)
        if len(v) < 4:
            continue
        left = _left(text, s + m.start())
        _literal(v, a, left, deep, add)
    if lang in ("env", "yaml"):
        for m in LINE.finditer(part):
            kind, v = name_kind(m["name"]), m["value"]
            if kind and plausible(v, kind, sure_name(m["name"])) or deep(v, kind):
                add(s + m.start("value"), s + m.end("value"), "assignment")
    for m in INNER.finditer(part):
        kind, v = name_kind(m["name"]), m["value"].rstrip(".,)")
        if kind and plausible(v, kind) and (lang != "py" and lang != "ts" and lang != "rs" or _strong(v) and not re.search(r"[(\[{]", v)):
            add(s + m.start("value"), s + m.start("value") + len(v), "assignment")
    for m in SAID.finditer(part):
        kind, v = name_kind(m["name"]), m["value"].rstrip(".:!?")
        if kind and plausible(v, kind) and _strong(v):
            line = part[part.rfind("\n", 0, m.start()) + 1 : m.start()]
            if lang == "text" or COMMENT.search(line):
                add(s + m.start("value"), s + m.start("value") + len(v), "comment")
    for m in LOGIN_PROSE.finditer(part) if has("log", "sign", "connect", "credential", "account", "user") else ():
        v = m["value"].rstrip(".:!?")
        if _strong(v) and not re.search(r"[({\[]|=>|::|//", v):
            add(s + m.start("value"), s + m.start("value") + len(v), "login")
    for m in PROSE.finditer(part) if has("pass", "pwd", "secret", "key", "token", "credential", "kennwort") else ():
        v = m["value"].rstrip(".:!?")
        direct = m["noun"].lower() in ("used key", "key")
        if part[m.end() : m.end() + 1] in ("(", "["):
            continue  # a call or an index: the value is looked up
        line = part[part.rfind("\n", 0, m.start()) + 1 : m.start()]
        if lang in ("ts", "py", "rs") and not m["quote"] and not COMMENT.search(line):
            continue
        if _strong(v) and (not direct or len(v) >= 16) and not re.search(r"[({\[]|=>|::", v) and name_kind(v.split("=")[0]) is None:
            add(s + m.start("value"), s + m.start("value") + len(v), "prose")


def _left(text: str, at: int) -> str:
    """What stands before a literal; more of it if the literal's line begins there."""
    line = text.rfind("\n", 0, max(0, at - 1))
    if not text[line + 1 : at].strip():
        return text[max(0, at - 240) : at]
    return text[max(0, at - 120, line - 60) : at]


def _literal(v: str, a: int, left: str, deep: Deep, add) -> None:
    if LOGIN_CALL.search(left) and plausible(v, "password"):
        add(a, a + len(v), "login")
        return
    m = LEFT.search(left)
    name = (m["quoted"] or m["name"]) if m else ""
    kind = name_kind(name) if name else None
    if kind and not re.search(r"[=!]=\s*\Z", left) and plausible(v, kind, sure_name(name) and not re.search(r"[(,]\s*\Z", left)):
        # a call takes a credential's name to look it up; a setter takes its value
        call = re.search(r"\(\s*\Z", left)
        setter = re.match(r"(?i)(?:set|with|use|add)", name.rsplit(".", 1)[-1])
        if not call or setter or re.search(r"=\s*\(\s*\Z", left):
            add(a, a + len(v), "assignment")
            return
    if len(v) >= 16 and (_ESC.search(v) or "%" in v or _B64.fullmatch(re.sub(r"\\n|\s", "", v)) or _HEX.fullmatch(v.strip())) and deep(v, kind):
        add(a, a + len(v), "encoded")


def _joined(text: str, m: re.Match, deep: Deep, add) -> None:
    """A literal written in pieces: judged as a whole, masked piece by piece."""
    at = m.start("args") if "args" in m.re.groupindex else m.start()
    pieces = [(at + p.start(p.lastgroup), at + p.end(p.lastgroup)) for p in LITERAL.finditer(text[at : m.end()])]
    whole = "".join(text[a:b] for a, b in pieces)
    if len(whole) < 8:
        return
    left = text[max(0, m.start() - 120) : m.start()]
    if "args" not in m.re.groupindex:
        left = re.sub(r"\(\s*\Z", "", left)
    known = LEFT.search(left)
    kind = name_kind(known["quoted"] or known["name"]) if known else None
    hits: list[Finding] = []
    if TOKENS.fullmatch(whole) and not is_placeholder(whole) or kind and plausible(whole, kind) or deep(whole, kind):
        hits = [Finding(0, len(whole), "pieces")]
    else:
        hits = [h for h in _find(whole, "text", lambda _v, _k: False) if h.kind != "prose"] if has_cue(whole) else []
    for h in hits:
        seen = 0
        first = True
        for a, b in pieces:
            lo, hi = max(h.start - seen, 0), min(h.end - seen, b - a)
            if lo < hi:
                add(a + lo, a + hi, "pieces" if first else "piece")
                first = False
            seen += b - a


def _merged(found: list[Finding]) -> list[Finding]:
    """Overlapping findings as one; the rest of a value in pieces stays apart."""
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if out and f.start < out[-1].end:
            out[-1] = Finding(out[-1].start, max(out[-1].end, f.end), f.kind if out[-1].kind == "piece" and f.kind != "pieces" else out[-1].kind)
        else:
            out.append(f)
    # a token found inside a later piece is part of the value that began before it
    return out


def redact(text: str, found: list[Finding]) -> str:
    """The text with every finding masked, line breaks and all else as they were."""
    out, at = [], 0
    for f in found:
        out.append(text[at : f.start])
        value = text[f.start : f.end]
        out.append("\n".join(MASK if p.strip() else p for p in value.split("\n")))
        at = f.end
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- on tables


def _scan_rows(n_keys: int, has_lang: bool, redacted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n_keys).to_pylist()
            langs = batch.column(n_keys + 1).to_pylist() if has_lang else ["text"] * len(texts)
            rows, lines, kinds, clean = [], [], [], []
            for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
                found = find(t, lang or "text") if t else []
                if redacted:
                    clean.append(redact(t, found) if t else t)
                    kinds.append(sum(f.kind != "piece" for f in found))
                    continue
                for f in found:
                    if f.kind != "piece":
                        rows.append(i)
                        lines.append(t.count("\n", 0, f.start) + 1)
                        kinds.append(f.kind)
            names = batch.schema.names[:n_keys]
            if redacted:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], pa.array(clean, pa.string()), pa.array(kinds, pa.int32())], names=[*names, "redacted", "n_credentials"])
            else:
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:n_keys]), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], names=[*names, "line_no", "kind"])

    return run


def _scan(df: DataFrame, keys: list[str], text: str, lang: str | None, redacted: bool, out: str) -> DataFrame:
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text, *([lang] if lang else [])).mapInArrow(_scan_rows(len(keys), lang is not None, redacted), f"{fields}, {out}")


def credentials(df: DataFrame, keys: list[str], text: str, lang: str | None = None) -> DataFrame:
    """``keys``, ``line_no`` (from 1, where the value starts) and ``kind`` of
    every credential.  Null and empty texts have none; a value in pieces is one;
    values that overlap are one; rows repeat if the input's do; extra columns are
    ignored.  Rows are scanned where they are read: no text is shuffled."""
    return _scan(df, keys, text, lang, False, "line_no int, kind string")


def redacted(df: DataFrame, keys: list[str], text: str, lang: str | None = None) -> DataFrame:
    """``keys``, ``redacted`` (the text with its credentials masked; null stays
    null) and ``n_credentials``."""
    return _scan(df, keys, text, lang, True, "redacted string, n_credentials int")
