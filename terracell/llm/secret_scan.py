"""Secret scanning with structural confirmation.

Three base kinds are found by their shape alone (assign, access, hex). Beyond
them, candidates in base64, base64url and hex alphabets are decoded, and only
reported if their inside parses:

- ``jwt``: two or three dot-separated base64url parts, the first a JSON object
  with a string ``alg``, the second a JSON object;
- ``der``: a DER element whose nested lengths fill their parents exactly and
  which is a private key: PKCS#1, SEC1, PKCS#8 whose octets parse as the key of its
  algorithm, or encrypted PKCS#8 under a password-based scheme;
- ``pem``: armour with ``Proc-Type`` and ``DEK-Info`` headers around whole cipher
  blocks, under the name of a private key;
- ``openssh``: the openssh-key-v1 container with its length-prefixed fields;
- ``sshpub``: an SSH public key blob (as many string fields as its type has).

Keys stand in base64 or hex, inside PEM armour (line ends may be written ``\\n``)
or bare, there also wrapped into lines of one width. A candidate begins wherever a
structure's first bytes stand, be it inside a longer run of its alphabet, and ends
where its lengths say; what is glued to either side stays outside the span.

Base spans always stay; ``confirmed`` says how many spans parsed. Offsets are
code points, end exclusive. Spans are ordered by start, then by kind in the
order of ``KINDS``.

Edge cases: null and empty texts have no spans. Whole texts are scanned; a
decoded candidate is parsed whole, nested no deeper than ``DEPTH``. Repeated rows
each get their row; extra columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.shared import tidy

KINDS = ("assign", "access", "hex", "jwt", "der", "pem", "openssh", "sshpub")
_ORDER = {k: i for i, k in enumerate(KINDS)}
DEPTH = 16

# The base patterns, their least lengths, and formats' magic numbers.
_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_SSH_MAGIC = b"openssh-key-v1\x00"
#: types of SSH public keys and the number of their fields, the type among them
_SSH_FIELDS = (
    (b"ssh-rsa", 3), (b"ssh-dss", 5), (b"ssh-ed25519", 2), (b"ssh-ed448", 2), (b"ecdsa-sha2-", 3),
    (b"sk-ssh-ed25519@", 3), (b"sk-ecdsa-sha2-", 4),
)
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_ONE_INTEGER = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"))  # DSA, DH
_CURVE25519 = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # PKCS#5, PKCS#12

_JWT = re.compile(rb"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{13,})\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
_JWT_HEAD = re.compile(rb"(?=e[yw]|[ICD])")  # a brace or white space comes first
_EDGE = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]*)-----")
_HEADER = re.compile(rb"\A\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+[^\n]*\n)*)+)\s*\n")
_DEK = re.compile(rb"DEK-Info:\s*([A-Z0-9-]+),([0-9A-Fa-f]+)")
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{40,}")
_NEXT_LINE = re.compile(rb"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+)")
#: where a structure may begin: 0x30 and a length; a container's magic; the length of a type's name
_BASE64_HEAD = re.compile(rb"(?=M[A-P]|b3BlbnNzaC1rZXktdjE|AAAA[BCEGI])")
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]{48,}")
_HEX_HEAD = re.compile(rb"(?=30|6[Ff]70656[Ee]7373682[Dd]|000000[012][0-9A-Fa-f](?:7373682[Dd]|6563647361|736[Bb]2[Dd]))")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def b64(raw: bytes) -> bytes | None:
    """Decoded base64 or base64url, with or without padding; None if it is neither."""
    raw = b"".join(raw.split()).rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_outline(data: bytes, depth: int = DEPTH) -> list | None:
    """[(tag, content or children)] if the elements fill ``data`` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, head = data[at], data[at + 1], 2
        if length & 0x80:
            k = length & 0x7F
            if not 1 <= k <= 4 or at + 2 + k > len(data):
                return None
            length, head = int.from_bytes(data[at + 2 : at + 2 + k], "big"), 2 + k
            if length < 0x80 or data[at + 2] == 0:  # DER wants the shortest form
                return None
        end = at + head + length
        if end > len(data):
            return None
        body = data[at + head : end]
        if tag & 0x20:
            inner = der_outline(body, depth - 1) if depth else None
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, body))
        at = end
    return out


def _integers(parts: list, n: int) -> bool:
    return len(parts) >= n and all(tag == 0x02 and body for tag, body in parts[:n])


def is_rsa_key(parts: list) -> bool:
    """PKCS#1: version and eight integers."""
    return _integers(parts, 9) and parts[0][1] in (b"\x00", b"\x01")


def is_ec_key(parts: list) -> bool:
    """SEC1: version 1 and the secret's octets, of a curve's width."""
    return len(parts) >= 2 and parts[0] == (0x02, b"\x01") and parts[1][0] == 0x04 and len(parts[1][1]) in (20, 21, 24, 28, 29, 30, 32, 36, 40, 48, 52, 64, 66, 72)


def is_key_of(algorithm: bytes, data: bytes) -> bool:
    """Whether the octets of a PKCS#8 shell are the key that its algorithm asks for."""
    inner = der_outline(data)
    if not inner or len(inner) != 1:
        return False
    tag, body = inner[0]
    if algorithm == _RSA:
        return tag == 0x30 and is_rsa_key(body)
    if algorithm == _EC:
        return tag == 0x30 and is_ec_key(body)
    if algorithm in _ONE_INTEGER:
        return tag == 0x02 and bool(body)
    if algorithm in _CURVE25519:
        return tag == 0x04 and len(body) == _CURVE25519[algorithm]
    return True  # another algorithm: its octets are one DER element that fills them


def is_private_key(data: bytes) -> bool:
    """Whether DER data is a private key, down to the key inside a shell."""
    top = der_outline(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = top[0][1]
    if len(parts) < 2:
        return False
    if parts[0][0] == 0x30:  # encrypted PKCS#8: scheme, octets
        scheme = parts[0][1]
        return len(parts) == 2 and parts[1][0] == 0x04 and len(parts[1][1]) >= 8 and len(scheme) == 2 and scheme[0][0] == 0x06 and scheme[0][1].startswith(_PBE) and scheme[1][0] == 0x30
    if is_rsa_key(parts) or is_ec_key(parts):
        return True
    if parts[0] not in ((0x02, b"\x00"), (0x02, b"\x01")) or len(parts) < 3 or parts[1][0] != 0x30 or parts[2][0] != 0x04:
        return False
    algorithm = parts[1][1]  # PKCS#8: version, algorithm, octets
    return bool(algorithm) and algorithm[0][0] == 0x06 and is_key_of(algorithm[0][1], parts[2][1])


def ssh_fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed strings that make up ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _fields_of(kind: bytes) -> int:
    return next((n for start, n in _SSH_FIELDS if kind.startswith(start)), 0)


def is_openssh(data: bytes) -> bool:
    """The openssh-key-v1 container: cipher, kdf, options, number of keys, keys, secret part."""
    return data.startswith(_SSH_MAGIC) and _openssh_end(lambda a, b: data[a:b]) == len(data)


def is_ssh_public(data: bytes) -> bool:
    fields = ssh_fields(data)
    return bool(fields) and len(fields) == _fields_of(fields[0])


Reader = Callable[[int, int], bytes]  # bytes a to b of a candidate, fewer at its end


def _openssh_end(read: Reader) -> int | None:
    """Where the container that begins here ends."""
    at, left = len(_SSH_MAGIC), 3
    for step in range(2):
        while left:
            size = read(at, at + 4)
            if len(size) < 4:
                return None
            if not step and left == 3 and size == b"\0\0\0\0":  # no cipher's name
                return None
            at, left = at + 4 + int.from_bytes(size, "big"), left - 1
        if not step:
            keys = int.from_bytes(read(at, at + 4), "big")
            at, left = at + 4, keys + 1 if 1 <= keys <= 64 else 0
            if not left:
                return None
    return at


def _public_end(read: Reader) -> int | None:
    """Where the SSH public key that begins here ends."""
    n = int.from_bytes(read(0, 4), "big")
    left, at = (_fields_of(read(4, 4 + n)) if n < 64 else 0), 0
    if not left:
        return None
    while left:
        size = read(at, at + 4)
        if len(size) < 4:
            return None
        at, left = at + 4 + int.from_bytes(size, "big"), left - 1
    return at


def _element(read: Reader, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, end) of the DER element at ``at``."""
    head = read(at, at + 6)
    if len(head) < 2:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4 or head[1] == 0x80 or len(head) < 2 + k:
        return None
    return head[0], at + 2 + k, at + 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def _der_end(read: Reader) -> int | None:
    """Where the private key that begins here would end: its children must chain up to it."""
    top = _element(read, 0)
    if top is None or top[0] != 0x30 or read(top[1], top[1] + 2)[:1] not in (b"\x02", b"\x30"):
        return None
    at = top[1]
    for _ in range(16):
        child = _element(read, at)
        if child is None or child[2] > top[2]:
            return None
        if child[2] == top[2]:
            return top[2]
        at = child[2]
    return None


def _structure(read: Reader) -> tuple[str, int] | None:
    """(kind, length in bytes) of the structure that begins here."""
    head = read(0, 5)
    if head[:1] == b"\x30":
        end = _der_end(read)
        return ("der", end) if end and len(data := read(0, end)) == end and is_private_key(data) else None
    if head[:3] == b"\0\0\0":
        end = _public_end(read)
        return ("sshpub", end) if end and len(read(end - 1, end)) == 1 else None
    if head == _SSH_MAGIC[:5] and read(0, len(_SSH_MAGIC)) == _SSH_MAGIC:
        end = _openssh_end(read)
        return ("openssh", end) if end and len(read(end - 1, end)) == 1 else None
    return None


def is_jwt(raw: bytes) -> bool:
    parts = raw.split(b".")
    for k, part in enumerate(parts[:2]):
        inside = b64(part)
        try:
            obj = json.loads(inside) if inside else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(obj, dict) or k == 0 and not isinstance(obj.get("alg"), str):
            return False
    return True


def _kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if data[0] == 0x30 and is_private_key(data):
        return "der"
    if is_openssh(data):
        return "openssh"
    return "sshpub" if is_ssh_public(data) else None


def _may_begin(part: bytes) -> bool:
    """Whether the beginning of a long base64url part may begin a JSON object; short parts are parsed whole."""
    if len(part) <= 4096:
        return True
    try:
        json.loads((b64(part[:4096]) or b"").decode("utf-8", "strict"))
    except UnicodeDecodeError as e:
        return e.end >= len(e.object) - 3  # cut inside a character
    except json.JSONDecodeError as e:
        return e.pos >= len(e.doc) - 16 or e.msg.startswith("Unterminated string")
    except RecursionError:
        return False
    return False  # complete before the part's end


def _tokens(raw: bytes) -> list[tuple[str, int, int]]:
    out, at = [], 0
    while m := _JWT.search(raw, at):
        at = m.end(1)  # what follows the first part may be a token
        for h in _JWT_HEAD.finditer(m[1]):
            head = b64(m[1][h.start() : h.start() + 12])
            if head and head.lstrip()[:1] in (b"", b"{") and _may_begin(m[1][h.start() :][:5000]) and is_jwt(m[0][h.start() :]):
                out.append(("jwt", m.start() + h.start(), m.end()))
                at = m.end()
                break
    return out


class _Lines:
    """The bytes that base64 characters from ``start`` on stand for; after ``end`` they may go on over lines of the first one's width."""

    def __init__(self, raw: bytes, start: int, end: int, wrapped: bool):
        self.raw, self.parts, self.width, self.open = raw, [(start, end)], end - start, wrapped
        self.before = [0]  # characters before each part

    def __call__(self, a: int, b: int) -> bytes:
        first, last = a // 3 * 4, -(-b // 3) * 4
        return (b64(self._chars(first, last)) or b"")[a - a // 3 * 3 :][: b - a]

    def _chars(self, first: int, last: int) -> bytes:
        while self.open and self.before[-1] + self.parts[-1][1] - self.parts[-1][0] < last:
            m = _NEXT_LINE.match(self.raw, self.parts[-1][1])
            n = m.end(1) - m.start(1) if m else 0
            if not 0 < n <= self.width:
                self.open = False
                break
            self.before.append(self.before[-1] + self.parts[-1][1] - self.parts[-1][0])
            self.parts.append((m.start(1), m.end(1)))
            self.open = n == self.width
        out = []
        for k in range(max(0, bisect.bisect_right(self.before, first) - 1), len(self.parts)):
            (start, end), skipped = self.parts[k], self.before[k]
            if skipped >= last:
                break
            out.append(self.raw[start + max(0, first - skipped) : min(end, start + last - skipped)])
        got = b"".join(out)
        return got[:-1] if len(got) % 4 == 1 else got

    def end_of(self, size: int) -> int:
        """Where the characters of the first ``size`` bytes end, their padding included."""
        chars = -(-4 * size // 3)
        k = bisect.bisect_left(self.before, chars) - 1
        at = self.parts[k][0] + chars - self.before[k]
        pad = -chars % 4
        return at + pad if pad and self.raw[at : at + pad] == b"=" * pad else at


def _in_base64(raw: bytes, start: int, end: int) -> list[tuple[str, int, int]]:
    """Structures that begin in the run start:end of base64 characters."""
    out, at = [], start
    for h in _BASE64_HEAD.finditer(raw, start, end):
        if (p := h.start()) < at or end - p < 24 and p > start:
            continue
        lines = _Lines(raw, p, end, wrapped=p == start)
        if found := _structure(lines):
            at = lines.end_of(found[1])
            out.append((found[0], p, at))
            if at > end:
                break
    return out


def _in_hex(raw: bytes, start: int, end: int) -> list[tuple[str, int, int]]:
    """Structures that begin in the run start:end of hex digits."""
    out, at = [], start
    for h in _HEX_HEAD.finditer(raw, start, end):
        if (p := h.start()) < at:
            continue
        read = lambda a, b, p=p: binascii.unhexlify(raw[p + 2 * a : p + min(2 * b, (end - p) // 2 * 2)]) if p + 2 * a < end else b""
        if found := _structure(read):
            at = p + 2 * found[1]
            out.append((found[0], p, at))
    return out


def _whole_blocks(header: bytes, body: bytes) -> bool:
    """Whether the headers name a cipher and its first block, and the body is whole blocks."""
    dek = _DEK.search(header)
    if not dek or not re.search(rb"Proc-Type:\s*4,\s*ENCRYPTED", header):
        return False
    block = 8 if b"DES" in dek[1] else 16
    return len(dek[2]) == 2 * block and len(body) > 0 and len(body) % block == 0


def _armoured(raw: bytes) -> list[tuple[str, int, int]]:
    out, begin = [], None
    for m in _EDGE.finditer(raw):
        if m[1] == b"BEGIN":
            begin = m
            continue
        if begin is None or begin[2] != m[2]:
            begin = None
            continue
        body = raw[begin.end() : m.start()].replace(b"\\r", b"").replace(b"\\n", b"\n")
        header = _HEADER.match(body)
        data = b64(body[header.end() :] if header else body)
        if data:
            found = _structure(lambda a, b, data=data: data[a:b])
            if found and found[1] == len(data):
                out.append((found[0], begin.start(), m.end()))
            elif header and m[2].endswith(b"PRIVATE KEY") and _whole_blocks(header[1], data):
                out.append(("pem", begin.start(), m.end()))
        begin = None
    return out


def scan(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, base spans and confirmed ones, unordered."""
    out: list[tuple[str, int, int]] = []
    low = raw.translate(_LOWER)
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in _ACCESS.finditer(raw)]
    out += [("hex", *m.span()) for m in _HEX.finditer(raw)]
    if b"." in raw:
        out += _tokens(raw)
    taken = _armoured(raw) if b"-----BEGIN " in raw else []
    edges = sorted(a for _, a, _ in taken), sorted(b for _, _, b in taken)
    inside = lambda p: bisect.bisect_right(edges[0], p) > bisect.bisect_right(edges[1], p)
    out += taken
    at = 0
    for m in _BASE64.finditer(raw):
        if m.start() >= at and not inside(m.start()):
            found = _in_base64(raw, *m.span())
            out += found
            at = max((b for _, _, b in found), default=at)
    if b"30" in raw or b"7373682" in raw or b"6563647361" in raw or b"736b2d" in low:
        for m in _HEX_RUN.finditer(raw):
            if not inside(m.start()):
                out += _in_hex(raw, *m.span())
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    found = scan(raw)
    if found and len(raw) != len(text):
        # code points that begin before each byte
        points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
        found = [(k, int(points[a]), int(points[b])) for k, a, b in found]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def find_secrets(docs: DataFrame, text: str = "text", column: str = "secrets") -> DataFrame:
    """docs with ``column``: array of (kind, start, end)."""
    docs = docs.drop(column)
    names = docs.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            got = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py())] for t in batch.column(names.index(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*names, column])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{ddl}, {column} array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets."""

    def cleaned(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for kind, a, b in spans(t):
            if a >= at:
                out += [t[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    names = docs.columns
    where = names.index(text)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[where] = pa.array([cleaned(t.as_py()) for t in batch.column(where)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidy(run), docs.schema)


def digest(found: list[tuple[str, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found if k in kinds)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans as one string."""
    found = find_secrets(docs.select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        (F.size("secrets") - F.size(base)).cast("bigint").alias("confirmed"),
    )


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(digest(spans(text), KINDS[:3]).encode()).hexdigest()
