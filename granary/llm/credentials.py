"""Credentials in source code and configuration files: places and offset-preserving masks.

The whole text is cut into subwords of a public vocabulary first. A string with few characters
per subword is one that no one would write by hand, and every such string of the text is a
candidate. Context rules then say what it is: an issued key, a private key, the user part of
an address, an authorization header, the value of a name, an option or a call; what no rule
explains, and what is a digest, an id or a placeholder, is no credential. How unnatural a value
must be depends on its context: where the context proves a secret (a password's name, the
user part of an address) nearly any value passes, as people make up passwords of words, and
where it only allows one, the value must be a candidate.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import arrays, subwords

# Names that end in one of these hold a credential.
SURE_NAMES = (
    "password passwd passwort passphrase passcode pwd pass kennwort clave contraseña contrasena senha motdepasse mdp пароль 密码 パスワード "
    "secret secretkey clientsecret apikey apisecret accesskey secretaccesskey privatekey signingkey encryptionkey masterkey authkey accountkey storagekey sharedkey"
).split()
#: Names that may hold a credential or something plain.
MAYBE_NAMES = "token credential credentials auth authorization".split()
# Formats of issued keys.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|xox[abeoprs]-[\w\-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[\w\-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|ya29\.[\w\-]{20,}|pypi-[\w\-]{40,}|dop_v1_[0-9a-f]{64}|eyJ[\w\-]{8,}\.eyJ[\w\-]{4,}\.[\w\-]{10,})(?![A-Za-z0-9_])"
)
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:CERTIFICATE|PUBLIC KEY)[^\n-]*-----.*?(?:-----END [^\n]*?-----|\Z)", re.S)
KEY_LINE = re.compile(r"[ \t#/;*]*[A-Za-z0-9+/=]{1,76}[ \t]*\r?\Z")
KEY_REST = re.compile(r"(?:(?:\r?\n|\\n)[ \t#/;*]*[A-Za-z0-9+/=:,\- ]{0,80})*")
USER_PART = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@\"'`<>]*:([^\s/@\"'`<>]+)@")
HEADER = re.compile(r"(?i)authorization")
SCHEME = re.compile(r"\b(?:Basic|Bearer|Token|token|bearer|basic)[ \t]+([A-Za-z0-9+/=_\-.~]{8,})")
NAME = r"[A-Za-zÀ-ɏЀ-ӿ一-鿿぀-ヿ_][\wÀ-ɏ.\-]*"
TEXT = r"\"(?P<{0}d>(?:[^\"\\\n]|\\.)*)\"|'(?P<{0}s>(?:[^'\\\n]|\\.)*)'|`(?P<{0}b>[^`\n]*)`"
NAMED = re.compile(rf"(?P<name>{NAME})[\"'`]?\]?\)?[ \t]*(?::[ \t]*[A-Za-z]+[ \t]*=|=>|:=|==?|:)[ \t]*(?:![\w]+[ \t]+)?(?:[rbuf]?(?:{TEXT.format('q')})|(?P<bare>[^\s\"'`<>,;(){{}}\[\]][^\s\"'`<>,;]*))")
PAIRED = re.compile(rf"[\"'](?P<name>{NAME})[\"'][ \t]*,[ \t]*(?:{TEXT.format('q')})")
OTHERWISE = re.compile(rf"(?P<name>{NAME})[\"'`]?[\])]?[ \t]*(?:\|\||\?\?|\?:|\bor\b)[ \t]*(?:{TEXT.format('q')})")
DEFAULT = re.compile(rf"\$\{{(?P<name>{NAME}):[-=]?(?P<bare>[^}}\s]+)\}}")
ELEMENT = re.compile(rf"<(?P<name>{NAME})(?:[ \t][^<>]*)?>(?P<bare>[^<>\s]+)</(?P=name)>")
ATTRIBUTE = re.compile(rf"\b(?:name|key|id)[ \t]*[=:][ \t]*[\"']?(?P<name>{NAME})[\"']?[\s,]+[\"']?value[\"']?[ \t]*[=:][ \t]*(?:{TEXT.format('q')}|(?P<bare>[^\s\"'<>,;]+))")
SPACED = re.compile(rf"(?:--?(?P<name>[A-Za-z][\w\-]*)[ \t]+|\b(?:ENV|ARG|set)[ \t]+(?P<other>{NAME})[ \t]+)(?:{TEXT.format('q')}|(?P<bare>[^\s\"'<>,;\-$][^\s\"'<>,;]*))")
LOGINS = (
    re.compile(rf"\bauth[ \t]*=[ \t]*\([ \t]*(?:\"[^\"\n]*\"|'[^'\n]*')[ \t]*,[ \t]*(?:{TEXT.format('q')})"),
    re.compile(rf"\b(?:login|authenticate|signIn|sign_in|connect|BasicAuth|SetBasicAuth|HTTPBasicAuth|basic_auth)\([ \t]*(?:\"[^\"\n]*\"|'[^'\n]*')[ \t]*,[ \t]*(?:{TEXT.format('q')})"),
    re.compile(rf"\bgetConnection\([ \t]*\"[^\"\n]*\"[ \t]*,[ \t]*\"[^\"\n]*\"[ \t]*,[ \t]*(?:{TEXT.format('q')})"),
    re.compile(r"\bsshpass[ \t]+-p[ \t]*[\"']?(?P<bare>[^\s\"']+)"),
    re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb|psql)\b[^\n|;]*?[ \t]-p(?P<bare>[^\s\"']+)"),
    re.compile(r"\bcurl\b[^\n|;]*?[ \t](?:-u|--user)[ \t]*[\"']?[^\s:\"']+:(?P<bare>[^\s\"']+)"),
    re.compile(r"\blogin (?:is|was)[ \t]+\S+[ \t]+/[ \t]+(?P<bare>\S+)"),
)
PLACEHOLDER = re.compile(
    r"(?i)\A(?:<.*>|\$.*|%.*|\{.*\}|\[.*\]|.*\$\{.*\}.*|.*\{\{.*\}\}.*|[x*.•_?#\-]+|\W*|(?:your|my|the|insert|enter|replace|change|put|add|todo|fixme)(?:[\W_].*|me.*|it.*|)"
    r"|.*(?:redacted|change[_\-]?me|replace[_\-]?me|placeholder|your[_\-]|[_\-]here\b|not[_\-]?set|masked|\bdummy\b|\bexample\b).*|null|none|nil|undefined|true|false|yes|no|on|off|empty|default|password|secret|token|passwd|string|str|int|optional)\Z"
)
CODE = re.compile(r"\A(?:[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)+|[A-Za-z_$][\w$.]*[(\[].*|@.*|&.*|new)\Z")
SPLIT = re.compile(r"[A-ZÀ-ÞА-Я]?[a-zß-ÿа-яё0-9]+|[A-ZÀ-ÞА-Я]+(?![a-zß-ÿа-яё])|[一-鿿぀-ヿ]+")
#: What every line with a named credential or a login holds a piece of, and what every issued key begins with.
HINT = re.compile(r"(?i)pass|pwd|secret|key|token|cred|auth|kennwort|clave|contrase|senha|mot.{0,2}de|mdp|парол|密码|パスワード|login|connect|sign.?in|sshpass|mysql|mariadb|psql|curl")
ISSUERS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "AIza", "npm_", "hf_", "SG.", "ya29.", "pypi-", "dop_v1_", "eyJ")
#: A string that no one writes by hand has fewer characters per subword than this.
UNNATURAL = 2.6
#: Under a name that holds a credential a value may be made of words, with up to so many characters per subword.
BY_HAND = 7.0
#: Candidates: runs without blanks, quotes, brackets and separators.
STRING = re.compile(r"[^\s\"'`<>,;(){}\[\]]{8,}")
# What may stand after the part of a name that says what it holds; marks between a name and its value.
QUALIFIERS = frozenset("prod production dev development test testing staging stage live qa old new backup default value str string env primary secondary".split())
BETWEEN = " \t\r\n\\\"'`(+|>-"
ASSIGNS = "=:>"
#: What makes a string the name of something itself.
IS_NAME = re.compile(r"[A-Za-z_][\w.\-]*[\"']?[ \t]*[=:]")
NAME_CHARS = re.compile(r"[\w.\-]")


RULES = ((NAMED, "named"), (PAIRED, "named"), (OTHERWISE, "fallback"), (DEFAULT, "fallback"), (ELEMENT, "named"), (ATTRIBUTE, "named"), (SPACED, "option"))


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    per_subword: float

    @property
    def evidence(self) -> str:
        """Whether the vocabulary proposed the value or its context alone."""
        return "unnatural" if self.per_subword < UNNATURAL else "context"


class Segments:
    """Where the subwords of a text begin: characters per subword of any part of it."""

    def __init__(self, text: str, path: str):
        encoding = subwords.encoding(path)
        sizes = subwords.byte_lengths(path)[np.array(encoding.encode_ordinary(text), dtype=np.int64)]
        begins = np.cumsum(sizes) - sizes
        if not text.isascii():
            lead = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8) & 0xC0 != 0x80
            # the character that holds each byte; a subword that begins inside a character counts there
            begins = (np.cumsum(lead) - 1)[begins]
        self.begins = begins

    def unnatural(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those of the spans that have few characters per subword."""
        if not spans:
            return []
        edges = np.array(spans, dtype=np.int64)
        first, last = np.searchsorted(self.begins, edges[:, 0]), np.searchsorted(self.begins, edges[:, 1])
        split = self.begins[np.minimum(first, len(self.begins) - 1)] > edges[:, 0]
        inside = last - first + (split | (first == last))
        return edges[(edges[:, 1] - edges[:, 0]) < UNNATURAL * np.maximum(1, inside)].tolist()

    def per_subword(self, start: int, end: int) -> float:
        """Characters per subword from ``start`` to ``end``; a subword that reaches into the part counts as one of it."""
        first, last = np.searchsorted(self.begins, [start, end])
        inside = int(last - first) + (1 if first == last or self.begins[first] > start else 0)
        return (end - start) / max(1, inside)


def strength(name: str) -> int:
    """2: the name holds a credential; 1: it may; 0: it does not."""
    parts = [p.lower().rstrip("0123456789") for p in SPLIT.findall(name)]
    parts = [p for p in parts if p]
    # a qualifier stands in the last part of a dotted name, not for one: hosts end in such words
    if len(SPLIT.findall(name.rpartition(".")[2])) > 1 and len(parts) > 1 and parts[-1] in QUALIFIERS:
        parts.pop()
    for many in (4, 3, 2, 1):
        tail = "".join(parts[-many:])
        if tail in SURE_NAMES:
            return 2
    return 1 if parts and parts[-1] in MAYBE_NAMES else 0


def plausible(value: str, sure: bool, per_subword: float, quoted: bool) -> bool:
    """Whether a value under a credential's name is one: by how unnatural it is, for what the name says, and by its characters."""
    if per_subword >= BY_HAND or PLACEHOLDER.match(value) or " " in value.strip() or len(value) < 4:
        return False
    if not quoted and CODE.match(value) and not re.search(r"\d", value):
        return False
    if not quoted and re.match(r"[A-Za-z_][\w.]*[(\[]", value):
        return False
    kinds = sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", r"\d", r"[^\w\-]"))
    if value.isdigit():
        return sure and quoted and len(value) >= 6
    if re.fullmatch(r"[A-Za-z]+(?:[_\-.][A-Za-z]+)*", value):
        return len(value) >= 8 and per_subword < UNNATURAL and not re.search(r"[_\-.]", value)
    return kinds >= 2 if sure else len(value) >= 8 and (per_subword < UNNATURAL or kinds >= 3)


def name_before(text: str, at: int) -> str:
    """The name that a string at ``at`` is the value of, also over one line break; empty without an assignment.

    Over a line break the value must be quoted, in brackets or in a block, so that a name
    without a value does not take the next line for one.
    """
    if IS_NAME.match(text, at):
        return ""
    k = at
    while k and text[k - 1] in BETWEEN:
        k -= 1
    passed = text[k:at]
    if "\n" in passed and (passed.count("\n") > 1 or not passed.strip(" \t\r\n")):
        return ""
    marked = any(x in ASSIGNS for x in passed)
    while k and text[k - 1] in ASSIGNS:
        k, marked = k - 1, True
    if not marked:
        return ""
    while k and text[k - 1] in " \t\"'`])":
        k -= 1
    end = k
    while k and NAME_CHARS.match(text[k - 1]):
        k -= 1
    return text[k:end]


def hinted_lines(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of the next line) of each line that holds a hint."""
    at = 0
    while m := HINT.search(text, at):
        begin = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        after = text.find("\n", end + 1)
        yield begin, end, len(text) if after < 0 else after
        at = end + 1
        if at > len(text):
            return


def key_start(text: str, end: int) -> int:
    """Where the lines of a private key begin whose footer begins at ``end`` and whose header is lost."""
    line = text.rfind("\n", 0, end) + 1
    if text[line:end].strip(" \t#/;*"):
        return end
    begin = end
    while line:
        before = text.rfind("\n", 0, line - 1) + 1
        if not KEY_LINE.match(text[before : line - 1]):
            break
        begin = before + len(text[before : line - 1]) - len(text[before : line - 1].lstrip(" \t#/;*"))
        line = before
    return begin


def find(text: str, path: str) -> list[Found]:
    """Credential values of one text, by place; of overlapping ones the longer."""
    found: list[Found] = []
    segments = Segments(text, path)
    per = segments.per_subword
    candidates = segments.unnatural([m.span() for m in STRING.finditer(text)])

    def add(start: int, end: int, kind: str) -> None:
        if end > start:
            found.append(Found(start, end, kind, per(start, end)))

    framed, closed = "-----" in text, set()
    for m in KEY_BEGIN.finditer(text) if framed else ():
        end = KEY_END.search(text, m.end())
        other = KEY_BEGIN.search(text, m.end())
        if end and (not other or end.start() < other.start()):
            last, body = end.end(), end.start()
            closed.add(last)
        else:
            last = body = m.end() + len(KEY_REST.match(text, m.end())[0].rstrip())
        # a description in place of the key's letters is no key
        if not text[m.end() : body].strip() or per(m.end(), body) < UNNATURAL:
            add(m.start(), last, "private_key")
    for m in KEY_END.finditer(text) if framed else ():
        if m.end() not in closed:
            add(key_start(text, m.start()), m.end(), "private_key")
    shut = [(f.start, f.end) for f in found] + ([m.span() for m in PUBLIC.finditer(text)] if framed else [])

    def free(start: int, end: int) -> bool:
        return not any(a < end and start < b for a, b in shut)

    def propose(m: re.Match, kind: str, sure: bool, quoted_only: bool = False) -> None:
        for group in ("qd", "qs", "qb", "bare"):
            value = m.groupdict().get(group)
            if value is None:
                continue
            start, end = m.span(group)
            quoted = group != "bare"
            if not quoted:
                value = value.rstrip(",;") if kind != "login" else value
                end = start + len(value)
            if KEY_BEGIN.search(value) or "://" in value or (quoted_only and not quoted) or not free(start, end):
                continue
            scheme = SCHEME.fullmatch(value)
            if scheme:
                continue
            if plausible(value, sure, per(start, end), quoted):
                add(start, end, kind)

    for m in ISSUED.finditer(text) if any(x in text for x in ISSUERS) else ():
        if free(*m.span()) and per(*m.span()) < UNNATURAL:
            add(*m.span(), "issued_key")
            shut.append(m.span())
    for m in USER_PART.finditer(text) if "://" in text and "@" in text else ():
        if not PLACEHOLDER.match(m[1]) and free(*m.span(1)) and not re.fullmatch(r"\d{2,5}", m[1]) and per(*m.span(1)) < BY_HAND:
            add(*m.span(1), "address")
            shut.append(m.span(1))
    headers = [m.end() for m in HEADER.finditer(text)]
    for m in SCHEME.finditer(text) if headers else ():
        k = bisect_right(headers, m.start())
        # the header's name stands before, in the same line or the one before it
        named = k and text.count("\n", headers[k - 1], m.start()) <= 1
        if named and not PLACEHOLDER.match(m[1]) and (per(*m.span(1)) < UNNATURAL or re.search(r"\d", m[1])) and free(*m.span(1)):
            add(*m.span(1), "authorization")
            shut.append(m.span(1))
    for begin, end, after in hinted_lines(text):
        for pattern, kind in RULES:
            at, last = begin, after if pattern is ATTRIBUTE else end
            while m := pattern.search(text, at, last):
                name = m.groupdict().get("name") or m.groupdict().get("other") or ""
                level = strength(name)
                if level:
                    propose(m, kind, level == 2)
                at = max(m.end("name") if m.groupdict().get("name") else m.start() + 1, m.start() + 1)
        for pattern in LOGINS:
            for m in pattern.finditer(text, begin, end):
                propose(m, "login", True)
    found.sort(key=lambda f: f.start)
    starts, ends = [f.start for f in found], list(accumulate((f.end for f in found), max))
    for start, end in candidates:
        k = bisect_left(starts, end)
        if k and ends[k - 1] > start:
            continue
        level = strength(name_before(text, start))
        value = text[start:end]
        if level and free(start, end) and "://" not in value and plausible(value, level == 2, per(start, end), text[start - 1 : start] in ("'", '"', "`")):
            add(start, end, "apart")
    found.sort(key=lambda f: (f.start, -(f.end - f.start)))
    kept: list[Found] = []
    for f in found:
        if kept and f.start < kept[-1].end:
            if f.end - f.start > kept[-1].end - kept[-1].start and kept[-1].kind not in ("private_key", "issued_key", "address"):
                kept[-1] = f
            continue
        kept.append(f)
    return kept


def masked(text: str, spans: list[Found], mark: str = "*") -> str:
    """The text with each value's characters but line breaks replaced: every offset stays."""
    parts, last = [], 0
    for f in spans:
        parts.append(text[last : f.start])
        parts.append(re.sub(r"[^\r\n]", mark, text[f.start : f.end]))
        last = f.end
    return "".join([*parts, text[last:]])


def find_credentials(df: DataFrame, id: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(id, start_char, end_char, kind, evidence, chars_per_subword), one row per credential value of ``df``.

    evidence: "unnatural" where the vocabulary proposed the value, "context" where only its name did.
    Null and empty texts have none; repeated rows give repeated spans; other columns are not
    read. tokenizer: path of the vocabulary on the executors.
    """
    path = tokenizer or subwords.vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(one, f) for one, body in zip(batch.column("id").to_pylist(), arrays.strings(batch, "text"), strict=True) for f in find(body, path)]
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array([r for r, _ in rows], pa.int64()),
                "start_char": pa.array([f.start for _, f in rows], pa.int32()),
                "end_char": pa.array([f.end for _, f in rows], pa.int32()),
                "kind": pa.array([f.kind for _, f in rows], pa.string()),
                "evidence": pa.array([f.evidence for _, f in rows], pa.string()),
                "chars_per_subword": pa.array([f.per_subword for _, f in rows], pa.float64()),
            }
        )

    narrow = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return arrays.arrow_map(narrow, run, "id long, start_char int, end_char int, kind string, evidence string, chars_per_subword double")


def redact_credentials(df: DataFrame, id: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(id, text, n_masked): every row of ``df`` with its values masked; null texts stay null."""
    path = tokenizer or subwords.vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for body in batch.column("text").to_pylist():
            spans = find(body, path) if body else []
            texts.append(masked(body, spans) if spans else body)
            counts.append(len(spans))
        return pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(texts, pa.string()), "n_masked": pa.array(counts, pa.int32())})

    narrow = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return arrays.arrow_map(narrow, run, "id long, text string, n_masked int")
