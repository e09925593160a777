"""The binary per-signal layout: integers, bit matrices, blocks, chunks and whole files, in numpy.

A file is a sequence of chunks: four-character code, length, payload, optional digest. Codes and
block headers below are fixed by the format.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

# Fixed values of the format
CHUNKS = (b"SRNX", b"RHDR", b"EPOC", b"EVTF", b"SOCD", b"SATE", b"SDIR")
ZEROS, NUMBERS = 0xFE, 0xFF
MATRIX = {0: 8, 1: 16, 2: 32}
DIGESTS = {0: 0, 2: 4, 6: 32, 20: 16, 21: 32, 22: 64}


def uleb(v: int) -> bytes:
    out = bytearray()
    while True:
        b, v = v & 127, v >> 7
        out.append(b | 128 if v else b)
        if not v:
            return bytes(out)


def sleb(v: int) -> bytes:
    return uleb((v << 1) if v >= 0 else ((-v) << 1) - 1)


def read_uleb(data: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = data[at]
        v |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return v, at


def read_sleb(data: bytes, at: int) -> tuple[int, int]:
    u, at = read_uleb(data, at)
    return (u >> 1) ^ -(u & 1), at


def _crc32c_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _crc32c_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _TABLE[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def digest(kind: int, data: bytes) -> bytes:
    if kind == 0:
        return b""
    if kind == 2:
        return crc32c(data).to_bytes(4, "little")
    if kind == 6:
        return hashlib.sha256(data).digest()
    if kind in (20, 21, 22):
        return hashlib.blake2b(data, digest_size=DIGESTS[kind]).digest()
    raise ValueError(f"digest {kind} is reserved")


def transpose(data: bytes, bits: int, count: int) -> np.ndarray:
    """count (8, 16 or 32) numbers of `bits` bits from a matrix stored most significant bits first."""
    m = np.unpackbits(np.frombuffer(data, np.uint8, bits * count // 8)).reshape(bits, count).astype(np.int64)
    out = -m[0]  # two's complement: the first bit is negative
    for row in m[1:]:
        out = out * 2 + row
    return out


def untranspose(values: np.ndarray, bits: int) -> bytes:
    v = np.asarray(values, np.int64).astype(np.uint64)
    rows = [((v >> np.uint64(k)) & np.uint64(1)).astype(np.uint8) for k in range(bits - 1, -1, -1)]
    return np.packbits(np.array(rows), axis=1).tobytes()


def pack_blocks(deltas: np.ndarray) -> bytes:
    out, at, n = bytearray(), 0, len(deltas)
    zero = deltas == 0
    # bits in two's complement
    m = np.where(deltas < 0, ~deltas, deltas)
    need = np.array([int(x).bit_length() + 1 for x in m], int) if n else np.zeros(0, int)
    while at < n:
        run = int(np.argmin(zero[at:])) if not zero[at:].all() else n - at
        if run >= 8 or run == n - at and run:
            out += bytes([ZEROS]) + uleb(run - 1)
            at += run
            continue
        for head, count in ((2, 32), (1, 16), (0, 8)):
            if n - at >= count and need[at : at + count].max() <= 32:
                bits = int(need[at : at + count].max())
                out.append(head << 5 | (bits - 1))
                out += untranspose(deltas[at : at + count], bits)
                at += count
                break
        else:
            count = min(8, n - at)
            out += bytes([NUMBERS]) + uleb(count - 1) + b"".join(sleb(int(x)) for x in deltas[at : at + count])
            at += count
    return bytes(out)


def unpack_blocks(data: bytes, at: int, end: int) -> np.ndarray:
    out = []
    while at < end:
        head, at = data[at], at + 1
        if head == ZEROS:
            n, at = read_uleb(data, at)
            out.append(np.zeros(n + 1, np.int64))
        elif head == NUMBERS:
            n, at = read_uleb(data, at)
            got = []
            for _ in range(n + 1):
                v, at = read_sleb(data, at)
                got.append(v)
            out.append(np.array(got, np.int64))
        elif head >> 5 in MATRIX:
            count, bits = MATRIX[head >> 5], (head & 31) + 1
            out.append(transpose(data[at : at + bits * count // 8], bits, count))
            at += bits * count // 8
        else:
            raise ValueError(f"block header {head:#x} is reserved")
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def encode_values(values: np.ndarray, order: int, scale: int | None = None) -> bytes:
    """Packed data with its length: schema, scale, state of the delta coder, blocks."""
    v = np.asarray(values, np.int64)
    if scale:
        if (v % scale).any():
            raise ValueError("values are not multiples of the scale")
        v = v // scale
    n = min(order, len(v), 7)
    state = []
    d = v[:n]
    for _ in range(n):  # levels at the n-th value
        state.append(int(d[-1]))
        d = np.diff(d)
    for _ in range(n):  # back to the place before the first
        for j in range(1, n):
            state[j - 1] -= state[j]
    # the state is such that the first n differences are zero
    deltas = v if n == 0 else np.concatenate([np.zeros(n, np.int64), np.diff(v, n)])
    body = uleb(n + (8 if scale else 0)) + (uleb(scale) if scale else b"") + b"".join(map(sleb, state)) + pack_blocks(deltas)
    return uleb(len(body)) + body


def decode_values(data: bytes, at: int) -> np.ndarray:
    size, at = read_uleb(data, at)
    end = at + size
    kind, at = read_uleb(data, at)
    if kind > 15:
        raise ValueError("encoding schema is reserved")
    scale, order = 1, kind & 7
    if kind & 8:
        scale, at = read_uleb(data, at)
    state = []
    for _ in range(order):
        v, at = read_sleb(data, at)
        state.append(v)
    v = unpack_blocks(data, at, end)
    for s in reversed(state):
        v = np.cumsum(v) + s
    return v * scale


def best_order(values: np.ndarray, most: int = 5) -> int:
    sizes = [len(encode_values(values, n)) for n in range(most + 1)]
    return int(np.argmin(sizes))


def encode_chars(chars: str) -> bytes:
    """Run-length encoded indicators with their length; blanks at the end are left out."""
    chars, out, at = chars.rstrip(" "), bytearray(), 0
    while at < len(chars):
        end = at
        while end < len(chars) and chars[end] == chars[at]:
            end += 1
        out += chars[at].encode() + uleb(end - at - 1)
        at = end
    return uleb(len(out)) + bytes(out)


def decode_chars(data: bytes, at: int, n: int) -> tuple[str, int]:
    size, at = read_uleb(data, at)
    end, out = at + size, ""
    while at < end:
        c, (k, at) = chr(data[at]), read_uleb(data, at + 1)
        out += c * (k + 1)
    return out.ljust(n), end


@dataclass
class Contents:
    """One file: header text, epochs (date, hh_mm, sec_e7, clock), special events (before epoch, text),
    and for each satellite its epochs' numbers and its signals, by code, with values and indicators.
    Events and satellites can also be iterators, in order, that are read once, events first."""

    header: str
    epochs: list[tuple[int, int, int, int]] = field(default_factory=list)
    events: list[tuple[int, str]] | Iterator[tuple[int, str]] = field(default_factory=list)
    #: sv -> (numbers of its epochs, {code: (numbers of the signal's epochs, values, lli, ssi)})
    satellites: dict | Iterator[tuple[str, tuple]] = field(default_factory=dict)


def header_codes(header: str) -> dict[str, list[str]]:
    """Code names by system, blank for version 2, from header text."""
    out: dict[str, list[str]] = {}
    system, left = " ", 0
    for line in header.split("\n"):
        name = line[60:80].rstrip()
        if name == "SYS / # / OBS TYPES":
            if line[0] != " ":
                system, left = line[0], int(line[3:6])
                out[system] = []
            got = [line[7 + 4 * j : 10 + 4 * j].strip() for j in range(13)]
        elif name == "# / TYPES OF OBSERV":
            if line[:6].strip():
                left = int(line[:6])
                out.setdefault(" ", [])
            got = [line[10 + 6 * j : 12 + 6 * j].strip() for j in range(9)]
        else:
            continue
        out[system if system in out else " "] += [c for c in got if c][: left - len(out[system if system in out else " "])]
    return out


def _tenths(e: tuple[int, int, int, int]) -> int:
    return (e[1] // 100 * 3600 + e[1] % 100 * 60) * 10_000_000 + e[2]


def encode_epochs(epochs: list[tuple[int, int, int, int]]) -> bytes:
    spans, k = [], 0
    while k < len(epochs):
        end, step = k + 1, 0
        day = lambda j: epochs[j][0] == epochs[k][0] and epochs[j][2] < 600_000_000
        if end < len(epochs) and day(k) and day(end) and _tenths(epochs[end]) > _tenths(epochs[k]):
            step = _tenths(epochs[end]) - _tenths(epochs[k])
            while end < len(epochs) and day(end) and _tenths(epochs[end]) - _tenths(epochs[end - 1]) == step:
                end += 1
        date, hm, sec, _ = epochs[k]
        interval = -(step // 10_000_000) if step and step % 10_000_000 == 0 else step
        spans.append(sleb(interval) + uleb(end - k - 1) + uleb(date) + uleb(hm // 100 * 10**11 + hm % 100 * 10**9 + sec))
        k = end
    clocks, out, k = [e[3] or 0 for e in epochs], b"", 0
    while clocks and clocks[-1] == 0:
        clocks.pop()
    while k < len(clocks):
        end = k
        while end < len(clocks) and clocks[end] == clocks[k]:
            end += 1
        out += sleb(clocks[k]) + uleb(end - k - 1)
        k = end
    return uleb(len(epochs)) + b"".join(spans) + out


def decode_epochs(data: bytes) -> list[tuple[int, int, int, int]]:
    total, at = read_uleb(data, 0)
    out: list[tuple[int, int, int, int]] = []
    while len(out) < total:
        interval, at = read_sleb(data, at)
        n, at = read_uleb(data, at)
        date, at = read_uleb(data, at)
        time, at = read_uleb(data, at)
        date = date if date >= 1_000_000 else date + (20_000_000 if date < 800_000 else 19_000_000)
        first = time // 10**11 * 3600 * 10**7 + time % 10**11 // 10**9 * 60 * 10**7 + time % 10**9
        step = -interval * 10**7 if interval < 0 else interval
        for k in range(n + 1):
            if k == 0:
                out.append((date, time // 10**11 * 100 + time % 10**11 // 10**9, time % 10**9, 0))
            else:
                t = first + k * step
                out.append((date, t // (3600 * 10**7) * 100 + t // (60 * 10**7) % 60, t % (60 * 10**7), 0))
    clocks: list[int] = []
    while at < len(data):
        c, at = read_sleb(data, at)
        n, at = read_uleb(data, at)
        clocks += [c] * (n + 1)
    return [(*e[:3], c) for e, c in zip(out, clocks + [0] * (len(out) - len(clocks)), strict=True)]


def encode_presence(numbers: list[int]) -> bytes:
    """The first gap is stored as it is, later ones less one; run lengths less one."""
    runs: list[list[int]] = []
    for k in numbers:
        if runs and runs[-1][0] + runs[-1][1] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    out, end = uleb(len(runs) - 1), 0
    for j, (start, n) in enumerate(runs):
        out += uleb(start - end - (1 if j else 0)) + uleb(n - 1)
        end = start + n
    return out


def decode_presence(data: bytes, at: int) -> list[int]:
    n, at = read_uleb(data, at)
    out, end = [], 0
    for j in range(n + 1):
        gap, at = read_uleb(data, at)
        size, at = read_uleb(data, at)
        start = end + gap + (1 if j else 0)
        end = start + size + 1
        out += range(start, end)
    return out


def encode_file(c: Contents, chunk_digest: int = 0, file_digest: int = 0) -> bytes:
    """A value is stored for every epoch of its satellite; one that is missing as 0 with blanks."""
    codes, out = header_codes(c.header), bytearray()

    def put(name: bytes, payload: bytes) -> int:
        at, chunk = len(out), name + uleb(len(payload)) + payload
        out.extend(chunk + digest(chunk_digest, chunk))
        return at

    fixed = lambda v: bytes([v & 127 | 128, v >> 7 & 127 | 128, v >> 14 & 127 | 128, v >> 21 & 127 | 128, v >> 28])  # noqa: E731  five bytes for any offset
    head = lambda sdir: uleb(1) + uleb(0) + uleb(chunk_digest) + uleb(file_digest) + fixed(sdir)
    put(b"SRNX", head(0))
    start = len(out)
    put(b"RHDR", c.header.encode())
    if c.epochs:
        epoc = put(b"EPOC", encode_epochs(c.epochs))
        evtf = [put(b"EVTF", uleb(k) + text.encode()) for k, text in (sorted(c.events, key=lambda x: x[0]) if isinstance(c.events, list) else c.events)]
        sates = {}
        for sv, (numbers, signals) in sorted(c.satellites.items()) if isinstance(c.satellites, dict) else c.satellites:
            place, socd = {k: i for i, k in enumerate(numbers)}, {}
            for code, (at, values, lli, ssi) in signals.items():
                v, l, s = np.zeros(len(numbers), np.int64), [" "] * len(numbers), [" "] * len(numbers)
                for k, x, a, b in zip(at, values, lli, ssi, strict=True):
                    v[place[k]], l[place[k]], s[place[k]] = x, a, b
                name = sv.encode().ljust(4, b"\0") + code.encode().ljust(4, b"\0")
                socd[code] = put(b"SOCD", name + uleb(len(numbers) - 1) + encode_chars("".join(l)) + encode_chars("".join(s)) + encode_values(v, best_order(v)))
            here = len(out)
            offsets = b"".join(sleb(socd[x] - here if x in socd else 0) for x in codes.get(sv[0], codes.get(" ", [])))
            sates[sv] = put(b"SATE", sv.encode() + b"\0" + offsets + encode_presence(numbers))
        sdir = put(b"SDIR", uleb(epoc) + uleb(evtf[0] if evtf else 0) + b"".join(sv.encode() + uleb(at) for sv, at in sates.items()))
        first = b"SRNX" + uleb(len(head(sdir))) + head(sdir)
        out[:start] = first + digest(chunk_digest, first)
    return bytes(out) + digest(file_digest, bytes(out))


class Ranged:
    """A seekable file as bytes: what is asked for is read, single bytes by pages that are kept."""

    PAGE, KEPT = 1 << 14, 64

    def __init__(self, f, size: int):
        self.f, self.size, self.pages, self.read_bytes = f, size, {}, 0

    def __len__(self) -> int:
        return self.size

    def _read(self, start: int, end: int) -> bytes:
        self.f.seek(start)
        self.read_bytes += end - start
        return self.f.read(end - start)

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, end, _ = at.indices(self.size)
            if end - start <= 8 and start // self.PAGE == max(start, end - 1) // self.PAGE:
                page = self._page(start // self.PAGE)
                return page[start % self.PAGE : start % self.PAGE + end - start]
            return self._read(start, max(start, end))
        return self._page(at // self.PAGE)[at % self.PAGE]

    def _page(self, k: int) -> bytes:
        if k not in self.pages:
            if len(self.pages) >= self.KEPT:
                self.pages.pop(next(iter(self.pages)))
            self.pages[k] = self._read(k * self.PAGE, min((k + 1) * self.PAGE, self.size))
        return self.pages[k]


class Store:
    """Reads one file, bytes or Ranged: by the directory's offsets where there is one, else by walking
    the chunks. The file's digest is verified where all bytes are at hand, chunk digests always."""

    def __init__(self, data: bytes | Ranged, verify: bool = True):
        if data[:4] != b"SRNX":
            raise ValueError("not a signal store")
        self.data = data
        size, at = read_uleb(data, 4)
        self.first, values = at + size, []
        for _ in range(5):
            v, at = read_uleb(data, at)
            values.append(v)
        if values[0] != 1:
            raise ValueError(f"major version {values[0]}")
        self.chunk_digest, self.file_digest, self.directory = values[2:]
        self.first += DIGESTS[self.chunk_digest]
        self.end = len(data) - DIGESTS[self.file_digest]
        if verify and isinstance(data, bytes) and digest(self.file_digest, data[: self.end]) != data[self.end :]:
            raise ValueError("file digest")
        self.verify = verify
        self.header = self.payload(self.first if data[self.first : self.first + 4] == b"RHDR" else self.offsets[b"RHDR"][0]).decode()
        self.codes = header_codes(self.header)

    @cached_property
    def offsets(self) -> dict[bytes, list[int]]:
        """Where chunks are, by walking over their heads."""
        out: dict[bytes, list[int]] = {}
        at = 0
        while at < self.end:
            size, body = read_uleb(self.data, at + 4)
            out.setdefault(bytes(self.data[at : at + 4]), []).append(at)
            at = body + size + DIGESTS[self.chunk_digest]
        return out

    @cached_property
    def from_directory(self) -> tuple[int, int, dict[str, int]]:
        """The places of the epochs, of the first event (0: none), and of the satellites."""
        p, out = self.payload(self.directory), {}
        epochs, at = read_uleb(p, 0)
        events, at = read_uleb(p, at)
        while at < len(p):
            name, (offset, at) = p[at : at + 3].decode(), read_uleb(p, at + 3)
            out[name] = offset
        return epochs, events, out

    def payload(self, at: int) -> bytes:
        size, body = read_uleb(self.data, at + 4)
        end = body + size
        if self.verify and digest(self.chunk_digest, self.data[at:end]) != self.data[end : end + DIGESTS[self.chunk_digest]]:
            raise ValueError("chunk digest")
        return self.data[body:end]

    def epochs(self) -> list[tuple[int, int, int, int]]:
        at = self.from_directory[0] if self.directory else next(iter(self.offsets.get(b"EPOC", [])), None)
        return [] if at is None else decode_epochs(self.payload(at))

    def events(self) -> list[tuple[int, str]]:
        if self.directory and not self.from_directory[1]:
            return []
        out = []
        for at in self.offsets.get(b"EVTF", []):
            p = self.payload(at)
            k, rest = read_uleb(p, 0)
            out.append((k, p[rest:].decode()))
        return out

    def satellites(self) -> dict[str, int]:
        """Satellites with the places of their chunks."""
        if self.directory:
            return self.from_directory[2]
        return {self.payload(at)[:3].decode(): at for at in self.offsets.get(b"SATE", [])}

    def satellite(self, at: int) -> tuple[list[int], dict[str, int]]:
        """A satellite's epochs, and where its signals are."""
        p, signals = self.payload(at), {}
        sv, k = p[:3].decode(), 4
        for code in self.codes.get(sv[0], self.codes.get(" ", [])):
            offset, k = read_sleb(p, k)
            if offset:
                signals[code] = at + offset
        return decode_presence(p, k), signals

    def signal(self, at: int) -> tuple[np.ndarray, str, str]:
        p = self.payload(at)
        n, k = read_uleb(p, 8)
        lli, k = decode_chars(p, k, n + 1)
        ssi, k = decode_chars(p, k, n + 1)
        return decode_values(p, k), lli, ssi
