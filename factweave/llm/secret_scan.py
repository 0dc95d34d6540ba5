"""Secret scans with structural confirmation.

Base kinds come from fixed patterns. Further candidates, runs of base64 or hex and dotted triples, are reported only
when what they decode to has the structure of a secret: a key in DER whose nested lengths add up, an OpenSSH key
container, or the header of a signed token.

Defined results: null and empty texts have no spans; spans count code points and their ends are exclusive; several
kinds may report the same place; equal rows get equal results; texts are scanned whole whatever their length; other
columns are not touched.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_texts

#: In the order in which kinds with equal starts are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der_key", "ssh_key", "signed_token")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key"))
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){24,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){24,}(?![0-9A-Za-z])")
LONG_HEX = re.compile(r"[0-9A-F]{48}|[0-9a-f]{48}")
#: Runs of base64 over line ends, which may be written as escapes and followed by an indent.
LINE_END = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]+={0,2})*")
#: A header begins with `{` and a quotation mark or white space.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: First bytes of an OpenSSH key container.
SSH_MAGIC = b"openssh-key-v1\0"
#: How the first bytes of a key look in base64: 0x30 of DER, or those of SSH_MAGIC. Lines have eight characters at least.
KEY_BEGINS = re.compile("M[A-P][A-Za-z0-9+/_-]{6}|b3BlbnNz")
#: Object identifiers of key algorithms, in DER (RSA, EC, X25519, Ed25519, DSA).
KEY_ALGORITHMS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2b656e"), bytes.fromhex("2b6570"), bytes.fromhex("2a8648ce380401"))


def decode64(run: str) -> bytes | None:
    """Bytes of standard or url-safe base64, with or without padding; None if it isn't base64."""
    body = run.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """(tag, value or children) of the elements that fill data[at:end] exactly; None where nested lengths don't add up."""
    end, found = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            found.append((tag, inner))
        else:
            found.append((tag, data[at : at + size]))
        at += size
    return found


def is_der_key(data: bytes) -> bool:
    """Private keys: PKCS#1 (nine integers), PKCS#8 (version, known algorithm, octets) or SEC 1 (1, octets, ...)."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if len(tags) < 2 or tags[0] != 0x02:
        return False
    if tags[:9] == [0x02] * 9 and parts[0][1] in (b"\0", b"\1"):
        return True
    if tags[:3] == [0x02, 0x30, 0x04] and parts[0][1] in (b"\0", b"\1"):
        return bool(parts[1][1]) and parts[1][1][0] in [(0x06, x) for x in KEY_ALGORITHMS]
    return tags[1] == 0x04 and parts[0][1] == b"\1" and len(parts[1][1]) in (28, 32, 48, 66)


def is_ssh_key(data: bytes) -> bool:
    """Container whose three leading strings' lengths stay inside the data."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data)


def is_token(header: str, payload: str) -> bool:
    """A JSON header that names its algorithm, and a payload that decodes."""
    raw, body = decode64(header), decode64(payload)
    if raw is None or body is None or not raw.lstrip().startswith(b"{"):
        return False
    try:
        parsed = json.loads(raw)
    except (ValueError, RecursionError):  # not JSON, or nested as no header is
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str)


def der_size(head: bytes) -> int | None:
    """Bytes of the element that begins with `head`."""
    if len(head) < 6 or not head[1] & 0x80:
        return 2 + head[1] if len(head) > 1 else None
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else None


def ssh_size(body: str, begin: int, parts: int = 6) -> int | None:
    """Bytes of the first parts of the OpenSSH container for one key that begins at body[begin]: behind the magic three strings,
    a number, the public and the private string. Only the lengths are decoded; None where they lead out of the body."""
    at, room = len(SSH_MAGIC), (len(body) - begin) * 3 // 4
    for part in range(parts):
        if part != 3:
            group = begin + at // 3 * 4
            found = (decode64(body[group : group + 8]) or b"")[at % 3 : at % 3 + 4]
            if len(found) < 4:
                return None
            at += int.from_bytes(found, "big")
        at += 4
        if at > room:
            return None
    return at


class Run:
    """Base64 over several lines: where its lines stand in the text, and its characters without what parts them."""

    def __init__(self, text: str, begin: int):
        self.end = RUN.match(text, begin).end()
        gaps = [m.span() for m in LINE_END.finditer(text, begin, self.end)]
        self.begins = [begin, *(b for _, b in gaps)]
        lines = [text[a:b].rstrip("=") for a, b in zip(self.begins, [*(a for a, _ in gaps), self.end], strict=True)]
        self.ends = [a + len(line) for a, line in zip(self.begins, lines, strict=True)]
        self.body = "".join(lines)
        self.chars = [0, *accumulate(map(len, lines))]  # before each line, and in all

    def at(self, place: int) -> int:
        """Which character of the body stands at a place of the text."""
        line = bisect_right(self.begins, place) - 1
        return self.chars[line] + place - self.begins[line]

    def line_end(self, chars: int) -> int | None:
        """Where in the text the line ends that ends with so many characters of the body; None if none does."""
        n = bisect_left(self.chars, chars, 1)
        return self.ends[n - 1] if n < len(self.chars) and self.chars[n] == chars else None


def _der_ends(run: Run, first: int) -> list[int]:
    """Where in the body a DER key that begins there ends: its first bytes say how long it is, and hold a version."""
    head = decode64(run.body[first : first + 12]) or b""
    size = der_size(head)
    if size is None or head[2 + (head[1] & 0x7F if head[1] & 0x80 else 0) :][:2] != b"\x02\x01":
        return []
    # Characters that hold that many bytes: `size` in whole groups of three, or the rest in two or three characters.
    return [first + size // 3 * 4 + (0, 2, 3)[size % 3]]


def _ssh_ends(run: Run, first: int) -> list[int]:
    """Where in the body a container that begins there may end: where its lengths say so, else with one of the last lines."""
    if not (decode64(run.body[first : first + 20]) or b"").startswith(SSH_MAGIC) or not ssh_size(run.body, first, 3):
        return []
    size = ssh_size(run.body, first)
    if size:
        n = bisect_left(run.chars, first + -(-size * 4 // 3), 1)
        if n < len(run.chars) and (run.chars[n] - first) * 3 // 4 == size:
            return [run.chars[n]]
    return [c for c in run.chars[:-5:-1] if c > first and (c - first) % 4 != 1]


def armoured(text: str) -> list[tuple[int, int, int]]:
    """Keys in base64: they may begin anywhere, and end where a line ends, with what pads it."""
    out, run, found = [], None, KEY_BEGINS.search(text)
    while found:
        begin = found.start()
        after = begin + 1
        if run is None or begin >= run.end:
            run = Run(text, begin)
        first = run.at(begin)
        ends, check, kind = (_der_ends, is_der_key, 3) if text[begin] == "M" else (_ssh_ends, is_ssh_key, 4)
        for last in ends(run, first):
            end = run.line_end(last)
            data = decode64(run.body[first:last]) if end else None
            if data and check(data):
                after = end
                end += len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
                out.append((begin, kind, end))
                break
        found = KEY_BEGINS.search(text, after)
    return out


def find(text: str | None) -> list[tuple[int, int, int]]:
    """All spans as (start, kind's place in KINDS, end), sorted."""
    if not text:
        return []
    out, low = [], text.lower()
    if "secret" in low or "token" in low or "passw" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if LONG_HEX.search(text):
        out += [(m.start(), 3, m.end()) for m in ANY_HEX.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    out += armoured(text)
    out += [(m.start(), 5, m.end()) for m in TOKEN.finditer(text) if is_token(m[1], m[2])]
    return sorted(set(out))


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of each row of (doc_id, text)."""

    def work(texts: list[str | None]) -> dict:
        rows = [find(t) for t in texts]
        out = {f"n_{BASE_KINDS[k]}": pa.array([sum(x[1] == k for x in r) for r in rows], pa.int64()) for k in range(3)}
        digest = [hashlib.sha256(say([x for x in r if x[1] < 3]).encode()).hexdigest() for r in rows]
        return out | {"base_sha256": pa.array(digest, pa.string()), "spans": pa.array([say(r) for r in rows], pa.string())}

    return map_texts(docs, "doc_id", "text", work, SCHEMA)


def blank_out(text: str | None) -> str | None:
    """The text with the longest stretch of touching or overlapping spans put as one placeholder each."""
    spans, out, at = find(text), [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:] if merged else text


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with its columns in their order; secrets of `text` are put out, and n_chars follows where there is one."""
    names = docs.columns

    def run(batches):
        for b in batches:
            texts = pa.array([blank_out(t) for t in b.column("text").to_pylist()], pa.string())
            yield b.set_column(names.index("text"), "text", texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in names else out
