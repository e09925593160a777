"""Cuts observation files into records: the one step that must go line by line.

How many lines a record has follows from its first line and from the header, so a file is framed in
order; files are framed in parallel. Lines come piece by piece, and no more than a piece and a record
is held, so files may have any size. Everything inside a record is left to column expressions. Bad
records become error rows, and framing goes on at the next line that can begin a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

RECORD = "file string, version string, compact boolean, rec_idx bigint, epoch_idx bigint, line_no bigint, kind string, head string, init boolean, clock string, codes string, lines array<string>, error string, reason string"
OBS, EVENT, ERROR, HEADER, WORD = "obs", "event", "error", "header", "word"
PLAIN, COMPACT, END, TYPES2, TYPES3 = "RINEX VERSION / TYPE", "CRINEX VERS   / TYPE", "END OF HEADER", "# / TYPES OF OBSERV", "SYS / # / OBS TYPES"  # labels fixed by the format

UINT = re.compile(r" *[0-9]*$")
FIXED = re.compile(r" *-?[0-9]*[.][0-9]* *$")


def label(line: str) -> str:
    return line[60:80].rstrip()


def uint(text: str) -> int | None:
    """Blank is 0; digits after blanks; else None."""
    return None if not UINT.match(text) else int(text) if text.strip() else 0


def code_lists(header: list[str], version: str) -> tuple[dict[str, int], dict[str, list[str]]] | None:
    """Number of codes and their names by system. Version 2 has one list, for the systems that column
    40 of the first line names: one, or with M all; blank there and in a satellite's name is G."""
    number: dict[str, int] = {}
    names: dict[str, list[str]] = {}
    if version == "2":
        letter, n = header[0][40:41], 0
        for line in header:
            if label(line) == TYPES2:
                got = uint(line[:6])
                if got is None:
                    return None
                n = got or n
                names.setdefault(" ", []).extend(line[10 + 6 * j : 12 + 6 * j].strip() for j in range(9))
        systems = " GRSECJIM" if letter == "M" else " G" if letter in " G" else letter
        number = dict.fromkeys(systems, n) if n else {}
    else:
        system = ""
        for line in header:
            if label(line) == TYPES3:
                if line[:1] != " ":
                    system, got = line[0], uint(line[3:6])
                    if got is None:
                        return None
                    number[system] = got
                names.setdefault(system, []).extend(line[7 + 4 * j : 10 + 4 * j].strip() for j in range(13))
    return (number, names) if number else None


def head2(line: str) -> tuple[str, int] | None:
    """Flag and count of a version-2 epoch line; None if a field is bad."""
    if len(line) < 32 or line[0] not in " &":
        return None
    flag, n = line[28], uint(line[29:32])
    times = [uint(line[a : a + 2]) for a in (1, 4, 7, 10, 13)]
    if flag not in "0123456" or n is None:
        return None
    if flag not in "2345" and (None in times or not FIXED.match(line[15:26]) or not line[1:3].strip()):
        return None
    if flag in "016" and 68 < len(line) <= 70:
        return None
    return flag, n


def head3(line: str) -> tuple[str, int] | None:
    if len(line) < 35 or line[0] != ">":
        return None
    flag, n = line[31], uint(line[32:35])
    times = [uint(line[a : a + w]) for a, w in ((2, 4), (7, 2), (10, 2), (13, 2), (16, 2))]
    if flag not in "0123456" or n is None:
        return None
    if flag not in "2345" and (None in times or not FIXED.match(line[18:29]) or len(line) > 56):
        return None
    return flag, n


def repaired(old: str, new: str) -> str:
    """A compact epoch line over the one before: blank keeps, & clears, all else replaces."""
    size = max(len(old), len(new))
    pairs = zip(old.ljust(size), new.ljust(size), strict=True)
    return "".join(a if b == " " else " " if b == "&" else b for a, b in pairs).rstrip()


SATELLITE = re.compile(r"[A-Z][ 0-9][0-9]").match
#: A satellite's name and whole fields of 16 characters: blank, or F14.3 with its point in column 11 (blank
#: digits behind it only after the others) and two characters.
FIELDS = re.compile(r"...(?: {16}|(?=[-0-9 ]{10}[.]) *-?[0-9]*[.](?:[0-9]{3}|[0-9]{2} |[0-9] {2}| {3})..)*$").match


def good_fields(line: str) -> bool:
    return FIELDS(line) is not None or FIELDS(line.ljust(3 + -(-(len(line) - 3) // 16) * 16)) is not None


BLANK8, FIRST2, FIRST6 = (np.frombuffer(x, np.uint64)[0] for x in (b" " * 8, b"\1\1" + b"\0" * 6, b"\1" * 6 + b"\0" * 2))


class Fields:
    """Fields of many lines at once: a field j of a line stands in 16 characters from first + 16 * j.

    Lines become rows of bytes of one width; a field is then two words of eight bytes, and a question to all
    its characters one comparison of words. good: lines whose fields are all blank or plainly F14.3 with two
    more characters (others have to be looked at one by one); filled and present, by line and field: not
    blank, and other than zero.
    """

    def __init__(self, lines: list[str], first: int, n: int, cut: bool = False):
        width = first + 16 * n
        self.raw = np.frombuffer("".join([x[:width].ljust(width) for x in lines]).encode("ascii", "replace"), np.uint8).reshape(len(lines), width)
        raw = np.ascontiguousarray(self.raw[:, first:])
        digit, blank, sign = raw - 48 < 10, raw == 32, raw == 45
        odd = ~(digit | blank | sign)  # no part of blanks, sign and digits in this order
        odd[:, :-1] |= (digit | sign)[:, :-1] & (blank | sign)[:, 1:]
        words = lambda x: x.view(np.uint64).reshape(len(lines), n, 2)
        text, some, odd = words(raw), words(raw - 49 < 9), words(odd)
        self.filled = (text != BLANK8).any(axis=2)
        self.present = (some[:, :, 0] | (some[:, :, 1] & FIRST6)) != 0
        number = (odd[:, :, 0] | (odd[:, :, 1] & FIRST2)) == 0
        digit = digit.reshape(len(lines), n, 16)
        point = (raw.reshape(len(lines), n, 16)[:, :, 10] == 46) & digit[:, :, 11] & digit[:, :, 12] & digit[:, :, 13]
        self.good = ((number & point) | ~self.filled).all(axis=1)
        if not cut:  # what follows the last field is looked at one by one
            self.good &= np.fromiter(map(len, lines), np.int64, len(lines)) <= width

    def named(self, limit: dict[str, int]) -> None:
        """Of lines that begin with a satellite's name: good also needs a name, of a system in limit, and
        no field from limit on."""
        where = np.full(256, -1)
        for system, n in limit.items():
            if "A" <= system <= "Z":
                where[ord(system)] = n
        n, tens, ones = where[self.raw[:, 0]], self.raw[:, 1], self.raw[:, 2]
        beyond = (self.filled & (np.arange(self.filled.shape[1]) >= n[:, None])).any(axis=1)
        self.good &= (n >= 0) & ((tens == 32) | (tens - 48 < 10)) & (ones - 48 < 10) & ~beyond


def pieces_of(text: str, size: int = 8000) -> Iterator[list[str]]:
    """The lines of a whole text, so many at a time."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if "\r" in text:
        lines = [x.rstrip("\r") for x in lines]
    yield from (lines[k : k + size] for k in range(0, len(lines), size))


def pieces_from(stream, size: int = 1 << 19) -> Iterator[list[str]]:
    """The lines of a binary stream, read in pieces."""
    rest = b""
    while data := stream.read(size):
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        if lines:
            text = b"\n".join(lines).decode("utf-8", "replace")
            yield [x.rstrip("\r") for x in text.split("\n")] if "\r" in text else text.split("\n")
    if rest:
        yield [rest.decode("utf-8", "replace").rstrip("\r")]


class Framer:
    """shapes: plain observation rows also have `shape`, which fields are filled and which are present."""

    def __init__(self, file: str, pieces: str | Iterable[list[str]], shapes: bool = False):
        self.shapes, self.fields, self.seen = shapes, None, {}
        self.file, self.more = file, iter(pieces_of(pieces) if isinstance(pieces, str) else pieces)
        self.lines: list[str] = []
        self.at = self.base = 0  # the next line's place in lines, and the number of lines[0]
        self.rec = self.epoch = -1
        self.version, self.compact, self.codes = None, False, None

    def fill(self, n: int) -> bool:
        """Whether n more lines are there."""
        while len(self.lines) - self.at < n:
            piece = next(self.more, None)
            if piece is None:
                return False
            self.base += self.at
            del self.lines[: self.at]
            self.lines += piece  # in place: a header without an end must not copy all before for each piece
            self.at = 0
            self.look()
        return True

    def look(self) -> None:
        """Looks at the fields of all lines at hand, once the header has told how many there are."""
        if self.codes is None or self.compact or not self.lines:
            return
        if self.version == "2":
            self.fields = Fields(self.lines, 0, 5, cut=True)
            return
        self.fields = Fields(self.lines, 3, max(self.n_obs.values()))
        self.fields.named(self.n_obs)

    def shape(self, a: int, b: int, systems: list[str]) -> dict:
        """Fields of the lines from a to b, of satellites of these systems; no field without a code."""
        if not self.shapes:
            return {}
        filled, present = self.fields.filled[a:b], self.fields.present[a:b]
        if self.version == "2":
            per = -(-max(self.n_obs.values()) // 5)
            filled, present = (x.reshape(len(systems), 5 * per) for x in (filled, present))
            known = self.known.get(" ", ())
            coded = np.zeros(filled.shape[1], bool)
            coded[: len(known)] = known
        else:
            coded = np.zeros((len(systems), filled.shape[1]), bool)
            for s in set(systems):
                known = self.known[s]
                coded[np.array([x == s for x in systems]), : len(known)] = known
        return {"shape": (filled & coded, present & coded)}

    def resync(self, begins) -> None:
        """On to the next line that can begin a record."""
        while self.fill(1) and not begins(self.lines[self.at]):
            self.at += 1

    def row(self, kind: str, line_no: int, **more) -> dict:
        if kind in (OBS, EVENT):
            self.rec += 1
        if kind == OBS:
            self.epoch += 1
        return {"file": self.file, "version": self.version, "compact": self.compact, "rec_idx": max(self.rec, 0) if kind != HEADER else -1, "epoch_idx": self.epoch + (kind == EVENT) if kind in (OBS, EVENT) else None, "line_no": line_no + 1, "kind": kind, "init": False, "lines": [], "codes": self.codes if kind == OBS else None} | more

    def bad(self, line_no: int, reason: str) -> dict:
        self.rec += 1
        return self.row(ERROR, line_no, error="BAD_FORMAT", reason=reason)

    def rows(self) -> Iterator[dict]:
        if not self.fill(1) or label(self.lines[0]) not in (PLAIN, COMPACT):
            yield self.row(ERROR, 0, error="UNSUPPORTED", reason="unrecognized file format")
            return
        start = 0
        if label(self.lines[0]) == COMPACT:
            self.compact = True
            self.fill(10)
            inner = next((i for i, x in enumerate(self.lines[:10]) if label(x) == PLAIN), None)
            container = self.lines[0][:20].strip()
            if inner is None or self.lines[0][20:40].rstrip() != "COMPACT RINEX FORMAT" or container != {"2": "1.0"}.get(self.lines[inner].strip()[:1], "3.0"):
                yield self.row(ERROR, 0, error="UNSUPPORTED", reason="compact container does not fit its content")
                return
            start = inner
        first, end = self.lines[start], start
        while self.fill(end + 1) and label(self.lines[end]) != END:
            end += 1
        self.version = first.strip()[:1] if first[:5] == "     " and first[5:7] in ("2.", "3.", "4.") else None
        if not self.fill(end + 1) or self.version is None or first[20:21] != "O":
            yield self.row(ERROR, 0, error="UNSUPPORTED", reason="version, type or end of header")
            return
        header = self.lines[start : end + 1]
        if any(not 60 < len(x) <= 80 for x in header):
            yield self.row(ERROR, 0, error="BAD_FORMAT", reason="length of a header line")
            return
        found = code_lists(header, self.version)
        yield self.row(HEADER, start, lines=header)
        if found is None:
            yield self.row(ERROR, 0, error="BAD_FORMAT", reason="observation types")
            return
        self.n_obs, names = found
        self.limit = {s: 3 + 16 * n for s, n in self.n_obs.items()}
        self.blank = "G" if self.n_obs.keys() >= {"G"} else next(iter(self.n_obs))
        self.codes = ";".join(f"{s}:{','.join(x[: self.n_obs.get(s) or max(self.n_obs.values())])}" for s, x in names.items() if s)
        self.known = {s: np.array([c != "" for c in x[: self.n_obs.get(s) or max(self.n_obs.values())]], bool) for s, x in names.items() if s}
        self.at = end + 1
        self.look()
        yield from self.compact_records() if self.compact else self.records()

    def records(self) -> Iterator[dict]:
        parse = head2 if self.version == "2" else head3
        per = -(-max(self.n_obs.values()) // 5)
        while self.fill(1):
            begin, got = self.base + self.at, parse(self.lines[self.at])
            if got is None:
                yield self.bad(begin, "epoch line")
                self.at += 1
                self.resync(parse)
                continue
            flag, n = got
            if flag in "2345":
                more = n
            elif self.version == "2":
                more = max(1, -(-n // 12)) - 1 + n * per
            else:
                more = n
            if not self.fill(1 + more):
                yield self.bad(begin, "end of file within a record")
                return
            block = self.lines[self.at : self.at + 1 + more]
            problem = None if flag in "2345" else self.problem(block, n)
            if problem:
                yield self.bad(begin, problem)
                self.at += 1
                self.resync(parse)
                continue
            here = self.at
            self.at += 1 + more
            if flag in "2345":
                yield self.row(EVENT, begin, head=block[0], lines=block)
            elif self.version == "2":
                heads = max(1, -(-n // 12))
                names = self.satellites(block, n)
                good, lines = self.fields.good[here + heads : here + 1 + more].all(), names
                if not (good and self.shapes):
                    lines = [names[k] + "".join(x[:80].ljust(80) for x in block[heads + k * per : heads + (k + 1) * per]) for k in range(n)]
                if good or all(map(good_fields, lines)):
                    shape = self.shape(here + heads, here + 1 + more, [x[0] for x in names])
                    yield self.row(OBS, begin, head=block[0], clock=block[0][68:].strip() if len(block[0]) > 70 else None, lines=lines, **shape)
                else:
                    yield self.bad(begin, "observation field")
            else:
                shape = self.shape(here + 1, here + 1 + more, [x[0] for x in block[1:]])
                yield self.row(OBS, begin, head=block[0], clock=block[0][41:].strip() if len(block[0]) > 43 else None, lines=block[1:], **shape)

    def satellites(self, block: list[str], n: int) -> list[str] | None:
        """Names in a version-2 record's first lines; None if one is bad. Lists come again and again."""
        svs = "".join(x[32:68].ljust(36) for x in block[: max(1, -(-n // 12))])[: 3 * n]
        if svs not in self.seen:
            names = [svs[3 * k : 3 * k + 3] for k in range(n)]
            good = all(re.match(r"[ A-Z][ 0-9][0-9]$", x) for x in names)
            if len(self.seen) == 1000:
                self.seen.clear()
            self.seen[svs] = [self.named(x) for x in names] if good else None
        return self.seen[svs]

    def named(self, name: str) -> str:
        return self.blank + name[1:] if name[0] == " " else name

    def problem(self, block: list[str], n: int) -> str | None:
        if self.version == "2":
            names = self.satellites(block, n)
            if names is None:
                return "satellite name"
            return None if {x[0] for x in names} <= self.n_obs.keys() else "system without observation types"
        if self.fields.good[self.at + 1 : self.at + 1 + n].all():
            return None
        body, limit = block[1:], self.limit
        if not all(map(SATELLITE, body)):
            return "satellite line"
        if not {x[0] for x in body} <= limit.keys():
            return "system without observation types"
        if any(len(x) > limit[x[0]] and x[limit[x[0]] :].strip() for x in body):
            return "text after the last field"
        return None if all(map(good_fields, body)) else "observation field"

    def compact_records(self) -> Iterator[dict]:
        epoch, mark, sats = None, "&" if self.version == "2" else ">", 32 if self.version == "2" else 41
        parse = head2 if self.version == "2" else lambda x: head3(x[:41].ljust(35))
        while self.fill(1):
            begin, line = self.base + self.at, self.lines[self.at]
            init = line[:1] == mark
            if init:
                epoch = " " + line[1:] if self.version == "2" else line
            elif epoch is not None and line[:1] in ("", " ", "&"):
                epoch = repaired(epoch, line)
            else:
                epoch = None
            got = parse(epoch.ljust(35)) if epoch is not None else None
            if got is not None and got[0] in "2345":
                self.fill(1 + got[1])
                block = self.lines[self.at : self.at + 1 + got[1]]
                self.at += len(block)
                yield self.row(EVENT, begin, head=epoch, lines=[epoch, *block[1:]])
                epoch = None  # the next epoch begins anew
                continue
            n = got[1] if got else 0
            names = [epoch[sats + 3 * k : sats + 3 * k + 3].ljust(3) for k in range(n)] if got else []
            here = self.fill(2 + n)
            block = self.lines[self.at + 1 : self.at + 2 + n]
            if got is None or not here or any(not re.match(r"[ A-Z][ 0-9][0-9]$", x) or self.named(x)[0] not in self.n_obs for x in names):
                yield self.bad(begin, "compact record")
                epoch = None
                self.at += 1
                self.resync(lambda x: x[:1] == mark)
                continue
            self.at += 2 + n
            yield self.row(OBS, begin, head=epoch, init=init, clock=block[0], lines=[self.named(a) + b for a, b in zip(names, block[1:], strict=True)])
