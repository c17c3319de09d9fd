"""SPSS system files (plain, bytecode-compressed and zlib-compressed) and portable files."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np

from statloom.sources.model import Fixed, StatFile, Stored, Variable, unpack_at

_MISSING = -1.7976931348623157e308
_SHOWN = {1: "A", 2: "AHEX", 3: "COMMA", 4: "DOLLAR", 5: "F", 6: "IB", 16: "N", 17: "E", 20: "DATE", 21: "TIME", 22: "DATETIME", 23: "ADATE", 24: "JDATE", 25: "DTIME", 26: "WKDAY", 27: "MONTH", 28: "MOYR", 29: "QYR", 30: "WKYR", 31: "PCT", 32: "DOT", 38: "EDATE", 39: "SDATE"}
_CODE = {v: k for k, v in _SHOWN.items()}


def _shown(kind: int, width: int, decimals: int) -> str:
    return f"{_SHOWN.get(kind, 'F')}{width}" + (f".{decimals}" if decimals or kind == 5 else "")


def _format_of(shown: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)(?:\.(\d+))?", shown)
    return _CODE[m[1]], int(m[2]), int(m[3] or 0)


def _expand(data: bytes, at: int, bias: float, need: int) -> bytes:
    """Bytecodes to plain 8-byte elements, at most ``need`` of them."""
    out, small = [], {k: struct.pack("<d", k - bias) for k in range(1, 252)}
    small |= {254: b" " * 8, 255: struct.pack("<d", _MISSING)}
    while at + 8 <= len(data) and len(out) < need:
        codes, at = data[at : at + 8], at + 8
        for code in codes:
            if code == 252:
                return b"".join(out)
            if code == 253:
                out.append(data[at : at + 8])
                at += 8
            elif code:
                out.append(small[code])
    return b"".join(out)


def read_sav(data: bytes | Stored, encoding: str | None = None, header_only: bool = False) -> StatFile:
    if data[:3] != b"$FL":
        raise ValueError("not an SPSS system file")
    end = "<" if unpack_at("<i", data, 64)[0] in (2, 3) else ">"
    if end == ">":
        raise ValueError("big-endian SPSS system files are not supported")
    _, _, packed, _, cases = unpack_at("<5i", data, 64)
    (bias,) = unpack_at("<d", data, 84)
    title = data[109:173]
    at, slots, long, wide, code = 176, [], {}, {}, encoding
    missing: dict[int, tuple] = {}
    while True:
        (kind,) = unpack_at("<i", data, at)
        at += 4
        if kind == 2:
            width, has_label, n_missing, shown, _ = unpack_at("<5i", data, at)
            name, label = data[at + 20 : at + 28], b""
            at += 28
            if has_label:
                (size,) = unpack_at("<i", data, at)
                label = data[at + 4 : at + 4 + size]
                at += 4 + -(-size // 4) * 4
            if n_missing:
                missing[len(slots)] = (n_missing, data[at : at + 8 * abs(n_missing)])
                at += 8 * abs(n_missing)
            slots.append((width, name.rstrip(), label, shown))
        elif kind == 3:
            (n,) = unpack_at("<i", data, at)
            at += 4
            for _ in range(n):
                at += 8 + -(-(data[at + 8] + 1) // 8) * 8
        elif kind == 4:
            (n,) = unpack_at("<i", data, at)
            at += 4 + 4 * n
        elif kind == 6:
            (n,) = unpack_at("<i", data, at)
            at += 4 + 80 * n
        elif kind == 7:
            sub, size, n = unpack_at("<3i", data, at)
            body = data[at + 12 : at + 12 + size * n]
            at += 12 + size * n
            if sub == 13:
                long = dict(x.split(b"=", 1) for x in body.split(b"\t") if b"=" in x)
            elif sub == 14:
                wide = {k: int(v.rstrip(b"\0")) for k, v in (x.split(b"=", 1) for x in body.split(b"\t") if b"=" in x)}
            elif sub == 20:
                code = code or body.decode("ascii", "replace")
        elif kind == 999:
            at += 4
            break
        else:
            raise ValueError(f"unknown record {kind} in an SPSS system file")
    code = code or "utf-8"
    text = lambda b: b.decode(code, "replace").rstrip(" \0")
    variables, layout, k = [], [], 0
    while k < len(slots):
        width, name, label, shown = slots[k]
        v = Variable(text(long.get(name, name)), "STRING" if width else "DOUBLE", _shown(shown >> 16, shown >> 8 & 255, shown & 255), text(label), width or 8)
        start, pieces = k, [(k, width)]
        total = wide.get(name, 0)
        k += max(1, -(-width // 8))
        if total > 255:
            v.width, v.format = total, f"A{total}"
            for _ in range(-(-total // 252) - 1):
                pieces.append((k, slots[k][0]))
                k += max(1, -(-slots[k][0] // 8))
        variables.append(v)
        layout.append((start, pieces))
    out = StatFile("sav", variables, label=text(title))
    n_slots = len(slots)

    def columns(raw: bytes) -> list[np.ndarray]:
        table, found = np.frombuffer(raw, np.uint8).reshape(-1, 8 * n_slots), []
        for v, (start, pieces) in zip(variables, layout):
            if v.type == "STRING":
                left, cut = v.width, []
                for slot, width in pieces:
                    used = min(width, 255, left)
                    cut.append(table[:, 8 * slot : 8 * slot + used])
                    left -= used
                own = np.ascontiguousarray(np.concatenate(cut, axis=1))
                found.append(np.array([text(b.tobytes()) for b in own] or [], object))
                continue
            x = np.ascontiguousarray(table[:, 8 * start : 8 * start + 8]).view("<f8").ravel().copy()
            x[x == _MISSING] = np.nan
            if start in missing:
                kind, own = missing[start]
                values = np.frombuffer(own, "<f8")
                if kind < 0:
                    x[(x >= values[0]) & (x <= values[1])] = np.nan
                    values = values[2:]
                x[np.isin(x, values)] = np.nan
            found.append(x)
        return found

    if not packed and n_slots:
        n = (len(data) - at) // (8 * n_slots)
        out.fixed = Fixed(at, 8 * n_slots, min(n, cases) if cases >= 0 else n, columns)
    if header_only or not n_slots:
        return out
    need = cases * n_slots if cases >= 0 else 1 << 62
    if packed == 2:
        _, trailer, _ = unpack_at("<3q", data, at)
        (blocks,) = unpack_at("<i", data, trailer + 20)
        parts = (unpack_at("<2q2i", data, trailer + 24 + 24 * i) for i in range(blocks))
        body = _expand(b"".join(zlib.decompress(data[p[1] : p[1] + p[3]]) for p in parts), 0, bias, need)
    else:
        body = _expand(data[at:], 0, bias, need) if packed else data[at:]
    n = len(body) // (8 * n_slots)
    n = min(n, cases) if cases >= 0 else n
    out.columns = columns(body[: 8 * n * n_slots])
    return out


def _pieces(v: Variable) -> list[int]:
    """Widths of the variables of the file that hold one; 0 for a number."""
    if v.type != "STRING" or v.width <= 255:
        return [v.width if v.type == "STRING" else 0]
    n = -(-v.width // 252)
    return [255] * (n - 1) + [max(1, v.width - 252 * (n - 1))]


def sav_block(variables: list[Variable], columns: list) -> bytes:
    """Plain rows from columns of numbers and lists of encoded texts."""
    cells = []
    for v, c in zip(variables, columns):
        if v.type != "STRING":
            cells.append(np.where(np.isnan(c), _MISSING, c).astype("<f8").view(np.uint8).reshape(len(c), 8))
            continue
        out = []
        for data in c:
            data = data[: v.width]
            for piece in _pieces(v):
                used, data = data[: min(piece, 255)], data[min(piece, 255) :]
                out.append(used.ljust(-(-piece // 8) * 8))
        cells.append(np.frombuffer(b"".join(out), np.uint8).reshape(len(c), -1))
    return np.hstack(cells).tobytes()


def write_sav(variables: list[Variable], blocks: Iterable[bytes], count: int, *, label: str = "", compression: str = "none"):
    """Chunks of the file's bytes; ``blocks`` are rows as sav_block() makes them. Compression: none, rows (bytecodes) or zlib."""
    packed = {"none": 0, "rows": 1, "rle": 1, "zlib": 2}[compression]
    slots: list[bytes] = []
    long, wide = [], []
    for k, v in enumerate(variables):
        name = f"V{k:07d}"[:8].encode()
        long.append(name + b"=" + v.name.encode())
        pieces = _pieces(v)
        if len(pieces) > 1:
            wide.append(name + b"=" + f"{v.width:05d}".encode() + b"\0")
        kind, width, decimals = _format_of(v.format) if v.type != "STRING" else (1, min(v.width, 255), 0)
        for j, piece in enumerate(pieces):
            text = v.label.encode()[:255] if j == 0 else b""
            shown = kind << 16 | min(piece or width, 255) << 8 | decimals
            own = struct.pack("<6i", 2, piece, bool(text), 0, shown, shown) + (name if j == 0 else f"V{k:04d}{j:03d}".encode())
            slots.append(own + (struct.pack("<i", len(text)) + text + bytes(-len(text) % 4) if text else b""))
            for _ in range(-(-piece // 8) - 1 if piece else 0):
                slots.append(struct.pack("<6i", 2, -1, 0, 0, 0, 0) + b" " * 8)
    blank = lambda s, n: s.encode()[:n].ljust(n)
    head = b"$FL3" if packed == 2 else b"$FL2"
    head += blank("@(#) SPSS DATA FILE", 60) + struct.pack("<5id", 2, len(slots), packed, 0, count, 100.0)
    head += blank("01 Jan 70", 9) + blank("00:00:00", 8) + blank(label, 64) + bytes(3) + b"".join(slots)
    extra = lambda sub, size, body: struct.pack("<4i", 7, sub, size, len(body) // size) + body
    head += extra(3, 4, struct.pack("<8i", 1, 0, 0, -1, 1, 1, 2, 65001)) + extra(4, 8, struct.pack("<3d", _MISSING, -_MISSING, np.nextafter(_MISSING, 0)))
    if long:
        head += extra(13, 1, b"\t".join(long))
    if wide:
        head += extra(14, 1, b"\t".join(wide) + b"\t")
    head += extra(20, 1, b"UTF-8") + struct.pack("<2i", 999, 0)
    yield head

    if not packed:
        yield from blocks
        return
    missing = struct.pack("<d", _MISSING)

    def coded() -> Iterable[bytes]:
        codes, held = bytearray(), []
        for row in blocks:
            for k in range(0, len(row), 8):
                e = row[k : k + 8]
                x = struct.unpack("<d", e)[0]
                if e == missing or e == b" " * 8:
                    codes.append(255 if e == missing else 254)
                elif x == x and x == int(x if abs(x) < 1e6 else 0) and 1 <= x + 100 <= 251 and (x or math.copysign(1, x) > 0):
                    codes.append(int(x) + 100)
                else:
                    codes.append(253)
                    held.append(e)
                if len(codes) == 8:
                    yield bytes(codes) + b"".join(held)
                    codes, held = bytearray(), []
        if codes:
            yield bytes(codes).ljust(8, b"\0") + b"".join(held)

    if packed == 1:
        yield from coded()
        return
    body, size = b"".join(coded()), 0x3FF000
    cut = [body[k : k + size] for k in range(0, len(body), size)]
    small = [zlib.compress(b) for b in cut]
    trailer = len(head) + 24 + sum(map(len, small))
    yield struct.pack("<3q", len(head), trailer, 24 + 24 * len(cut)) + b"".join(small)
    yield struct.pack("<2q2i", -100, 0, size, len(cut))
    plain, at = len(head), len(head) + 24
    for b, s in zip(cut, small):
        yield struct.pack("<2q2i", plain, at, len(b), len(s))
        plain, at = plain + len(b), at + len(s)


# -- portable files -----------------------------------------------------------------------------------------------------

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRST"
#: the characters at places 64 and on of the translation table
_TABLE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz .<(+|&[]!$*);^-/|,%_>?`:$@'=\""


def base30(x: float) -> str:
    """A number in base 30, ``*.`` for a missing one."""
    if x != x or math.isinf(x):
        return "*."
    sign, x = ("-" if x < 0 else ""), abs(x)
    if x == int(x) and x < 2**62:
        n, out = int(x), ""
        while n:
            n, r = divmod(n, 30)
            out = _DIGITS[r] + out
        return sign + (out or "0") + "/"
    power = 0
    f = Fraction(x)
    while f >= 30:
        f, power = f / 30, power + 1
    while f < 1:
        f, power = f * 30, power - 1
    n = round(f * 30**12)  # 13 digits of base 30 hold any double
    digits = ""
    while n:
        n, r = divmod(n, 30)
        digits = _DIGITS[r] + digits
    stripped, tail = digits.rstrip("0"), ""
    power += len(digits) - len(stripped) - 12
    if power:
        n = abs(power)
        while n:
            n, r = divmod(n, 30)
            tail = _DIGITS[r] + tail
        tail = ("+" if power > 0 else "-") + tail
    return sign + stripped + tail + "/"


def _unfold(raw: bytes) -> bytes:
    """Lines put together, short ones filled up to 80 characters; what stands behind the last line break stays as it is."""
    if len(raw) % 82 == 0 and raw[80:82] == b"\r\n":
        lines = np.frombuffer(raw, np.uint8).reshape(-1, 82)
        if (lines[:, 80] == 13).all() and (lines[:, 81] == 10).all() and not (lines[:, :80] == 10).any():
            return np.ascontiguousarray(lines[:, :80]).tobytes()
    lines = raw.replace(b"\r\n", b"\n").split(b"\n")
    return b"".join(x.ljust(80) for x in lines[:-1]) + lines[-1]


class _Portable:
    def __init__(self, data: bytes, encoding: str):
        text = _unfold(data)
        at = text.find(b"SPSSPORT")
        if at < 256 or at > 600:
            raise ValueError("not an SPSS portable file")
        table = text[at - 256 : at]
        turn = bytearray(range(256))
        for k, ch in enumerate(_TABLE):
            if table[64 + k] not in (0, 0x30) or ch == "0":
                turn[table[64 + k]] = ord(ch)
        self.turn = bytes(turn)
        self.text, self.at, self.encoding = text.translate(self.turn), at + 8, encoding

    def tag(self) -> str:
        self.at += 1
        return chr(self.text[self.at - 1])

    def number(self) -> float:
        while self.text[self.at] == 32:
            self.at += 1
        if self.text[self.at] == ord("*"):
            self.at += 2
            return math.nan
        end = self.text.index(b"/", self.at)
        raw, self.at = self.text[self.at : end].decode("ascii"), end + 1
        m = re.fullmatch(r"(-?)([0-9A-T]*)(?:\.([0-9A-T]*))?(?:([+-])([0-9A-T]+))?", raw)
        if not m:
            raise ValueError(f"bad number '{raw}' in an SPSS portable file")
        digits = m[2] + (m[3] or "")
        value = 0
        for d in digits:
            value = value * 30 + _DIGITS.index(d)
        power = sum(_DIGITS.index(d) * 30**i for i, d in enumerate(reversed(m[5] or ""))) * (-1 if m[4] == "-" else 1) - len(m[3] or "")
        return float(Fraction(value) * Fraction(30) ** power) * (-1 if m[1] else 1)

    def string(self) -> bytes:
        n = int(self.number())
        self.at += n
        return self.text[self.at - n : self.at]


def _por_variables(p: _Portable) -> tuple[list[Variable], list[list]]:
    """Variables and their ranges of missing values; leaves ``p`` where the data begin."""
    text = lambda b: b.decode(p.encoding, "replace").rstrip()
    p.tag(), p.string(), p.string()
    variables: list[Variable] = []
    gone: list[list] = []
    while True:
        tag = p.tag()
        if tag in "123E" and tag != "E":
            p.string()
        elif tag in "45":
            p.number()
        elif tag == "6":
            p.string()
        elif tag == "7":
            width = int(p.number())
            name = text(p.string())
            kind, w, d, *_ = [int(p.number()) for _ in range(6)]
            variables.append(Variable(name, "STRING" if width else "DOUBLE", _shown(kind, w, d), "", width or 8))
            gone.append([])
        elif tag in "89AB":
            if variables[-1].type == "STRING":
                p.string()
            else:
                low = p.number() if tag != "9" else -math.inf
                high = low if tag == "8" else math.inf if tag == "A" else p.number()
                gone[-1].append((low, high))
        elif tag == "C":
            variables[-1].label = text(p.string())
        elif tag == "D":
            names = {text(p.string()) for _ in range(int(p.number()))}
            strings = any(v.type == "STRING" for v in variables if v.name in names)
            for _ in range(int(p.number())):
                p.string() if strings else p.number()
                p.string()
        elif tag == "E":
            for _ in range(int(p.number())):
                p.string()
        elif tag == "F":
            break
        elif tag != " ":
            raise ValueError(f"unknown record '{tag}' in an SPSS portable file")
    return variables, gone


def _por_head(data: bytes | Stored, encoding: str | None) -> tuple[_Portable, list[Variable], list[list]]:
    """The same from as much of the file's beginning as its header takes."""
    size = 1 << 16
    while True:
        whole = size >= len(data)
        p = _Portable(data[:] if whole else data[: data[:size].rfind(b"\n") + 1], encoding or "utf-8")
        try:
            return p, *_por_variables(p)
        except (IndexError, ValueError):
            if whole:
                raise
            size *= 4


#: bytes of a portable file that are looked at together: so many lines as they are written
POR_BLOCK = 82 * 100_000


def _por_blocks(data: Stored, turn: bytes, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Places of blocks of whole lines in the file, and their characters."""
    while start < len(data):
        n = POR_BLOCK
        raw = data.read(start, n)
        while start + len(raw) < len(data) and b"\n" not in raw:
            n *= 4
            raw = data.read(start, n)
        if start + len(raw) < len(data):
            raw = raw[: raw.rfind(b"\n") + 1]
        yield start, np.frombuffer(_unfold(raw).translate(turn), np.uint8)
        start += len(raw)


def _number_ends(text: np.ndarray, starred: bool = False) -> np.ndarray:
    """Places of the last characters of numbers: a slash, or what follows an asterisk (``starred``: one stood before)."""
    star, ends = text == ord("*"), text == ord("/")
    if starred or star.any():
        after = np.concatenate([[starred], star[:-1]])
        ends = ends & ~after | after
    return np.flatnonzero(ends)


def por_cuts(data: Stored, encoding: str | None) -> list[tuple[int, int]] | None:
    """Where each block's first row begins and where rows end, as places of lines and characters behind them.

    None for files with texts: what they hold can't be told from numbers, so they are read from their beginning.
    """
    p, variables, _ = _por_head(data, encoding)
    if not variables or any(v.type == "STRING" for v in variables):
        return None
    cuts, skip, count, starred = [], p.at, 0, False
    for start, text in _por_blocks(data, p.turn):
        if skip > len(text):
            skip -= len(text)
            continue
        last = np.flatnonzero(text[skip:] == ord("Z"))[:1] + skip
        ends = _number_ends(text[skip:], starred) + skip
        ends = ends[ends < last[0]] if len(last) else ends
        if not cuts:
            cuts.append((start, skip))
        else:
            first = -count % len(variables) or len(variables)
            if len(ends) >= first:
                cuts.append((start, int(ends[first - 1]) + 1))
        count, starred, skip = count + len(ends), bool(text[-1] == ord("*")), 0
        stop = (start, int(last[0]) if len(last) else len(text))
        if len(last):
            break
    if cuts:
        rest = text[int(ends[-1]) + 1 if len(ends) else 0 if len(cuts) > 1 else cuts[0][1] : stop[1]]
    if cuts and (count % len(variables) or (rest != ord(" ")).any()):
        raise ValueError("an SPSS portable file ends within a row")
    return [*cuts, stop] if cuts else []


def por_columns(data: Stored, encoding: str | None, cut: tuple[int, int], stop: tuple[int, int], step: int) -> Iterator[list[np.ndarray]]:
    """Columns of numbers, about ``step`` rows each, of the rows from one of por_cuts() to another."""
    p, variables, gone = _por_head(data, encoding)
    left, n = np.zeros(0, np.uint8), len(variables)
    for start, text in _por_blocks(data, p.turn, cut[0]):
        text = text[cut[1] if start == cut[0] else 0 : stop[1] if start == stop[0] else None]
        text = np.concatenate([left, text])
        ends = _number_ends(text)
        ends = ends[: len(ends) // n * n]
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        for k in range(0, len(ends), step * n):
            table = _base30_values(text, starts[k : k + step * n], ends[k : k + step * n]).reshape(-1, n)
            columns = [np.ascontiguousarray(table[:, i]) for i in range(n)]
            for c, bad in zip(columns, gone):
                for low, high in bad:
                    c[(c >= low) & (c <= high)] = np.nan
            yield columns
        left = text[ends[-1] + 1 :] if len(ends) else text
        if start >= stop[0]:
            return


_PLACE = np.full(256, -1, np.int64)
_PLACE[np.frombuffer(_DIGITS.encode(), np.uint8)] = np.arange(30)


def _base30_values(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers that begin and end at these places; whole ones of up to 12 digits at once, others one by one."""
    starts = starts.copy()
    while (blank := (text[starts] == 32) & (starts < ends)).any():
        starts += blank
    missing, minus = text[starts] == ord("*"), text[starts] == ord("-")
    first = starts + minus
    size = ends - first
    plain = (size > 0) & (size <= 12) & ~missing
    value = np.zeros(len(starts), np.int64)
    for j in range(int(size[plain].max()) if plain.any() else 0):
        inside = plain & (j < size)
        digit = _PLACE[text[np.where(inside, first + j, 0)]]
        plain &= ~inside | (digit >= 0)
        value = np.where(inside & plain, value * 30 + digit, value)
    out = np.where(minus, -value.astype(float), value.astype(float))
    out[missing] = np.nan
    known: dict[bytes, float] = {}
    for i in np.flatnonzero(~plain & ~missing):
        token = text[starts[i] : ends[i] + 1].tobytes()
        if token not in known:
            p = _Portable.__new__(_Portable)
            p.text, p.at = token, 0
            known[token] = p.number()
        out[i] = known[token]
    return out


def _base30_cells(x: np.ndarray) -> np.ndarray:
    """base30() of each as a row of characters, with zeros among them where there is none."""
    with np.errstate(invalid="ignore"):
        whole = np.isfinite(x) & (x == np.floor(x)) & (np.abs(x) < 30.0**12)
    n, columns = np.abs(np.where(whole, x, 0)).astype(np.int64), [np.where(whole, ord("/"), 0).astype(np.uint8)]
    digits = np.frombuffer(_DIGITS.encode(), np.uint8)
    used = whole
    while used.any():
        columns.append(np.where(used, digits[n % 30], 0).astype(np.uint8))
        n //= 30
        used = n > 0
    columns.append(np.where(whole & (x < 0), ord("-"), 0).astype(np.uint8))
    cells = np.stack(columns[::-1], axis=1)
    if not whole.all():
        some, at = np.unique(x[~whole], return_inverse=True)
        other = np.array([base30(v).encode() for v in some.tolist()])
        wide = np.zeros((len(x), other.dtype.itemsize), np.uint8)
        wide[~whole] = other[at].view(np.uint8).reshape(-1, other.dtype.itemsize)
        cells = np.hstack([cells, wide])
    return cells


def por_block(variables: list[Variable], columns: list) -> bytes:
    """Rows from columns of numbers and lists of encoded texts."""
    if all(v.type != "STRING" for v in variables):
        cells = np.hstack([_base30_cells(c) for c in columns])
        return cells[cells != 0].tobytes()
    parts = []
    for v, c in zip(variables, columns):
        if v.type == "STRING":
            # an empty text is one blank: no text has length 0 in this format
            cut = [(x or b" ")[: v.width] for x in c]
            parts.append([base30(len(x)).encode() + x for x in cut])
        else:
            parts.append([x[x != 0].tobytes() for x in _base30_cells(c)])
    return b"".join(x for row in zip(*parts) for x in row)


def read_por(data: bytes | Stored, encoding: str | None = None, header_only: bool = False) -> StatFile:
    if header_only:
        p, variables, gone = _por_head(data, encoding)
        return StatFile("por", variables)
    p = _Portable(data[:], encoding or "utf-8")
    variables, gone = _por_variables(p)
    text = lambda b: b.decode(p.encoding, "replace").rstrip()
    out = StatFile("por", variables)
    rows: list[list] = [[] for _ in variables]
    while variables and p.at < len(p.text) and p.text[p.at : p.at + 1] != b"Z":
        for c, v in zip(rows, variables):
            c.append(text(p.string()) if v.type == "STRING" else p.number())
    for c, v, bad in zip(rows, variables, gone):
        a = np.array(c, object if v.type == "STRING" else float)
        for low, high in bad:
            a[(a >= low) & (a <= high)] = np.nan
        out.columns.append(a)
    return out


def write_por(variables: list[Variable], blocks: Iterable[bytes], count: int, *, label: str = ""):
    """Chunks of the file's bytes, lines of 80 characters; ``blocks`` are rows as por_block() makes them."""
    string = lambda b: base30(len(b)).encode() + b
    table = bytearray(b"0" * 256)
    table[64 : 64 + len(_TABLE)] = _TABLE.encode()

    def parts() -> Iterable[bytes]:
        yield b"ASCII SPSS PORT FILE".ljust(40) * 5 + bytes(table) + b"SPSSPORT" + b"A" + string(b"19700101") + string(b"000000")
        yield b"1" + string(b"statloom") + (b"2" + string(label.encode()) if label else b"") + b"4" + base30(len(variables)).encode() + b"5" + base30(11).encode()
        for v in variables:
            kind, width, decimals = _format_of(v.format) if v.type != "STRING" else (1, v.width, 0)
            shown = "".join(map(base30, (kind, width, decimals))).encode()
            yield b"7" + base30(v.width if v.type == "STRING" else 0).encode() + string(v.name.encode()) + shown * 2
            if v.label:
                yield b"C" + string(v.label.encode()[:255])
        yield b"F"
        yield from blocks
        yield b"Z"

    held = b""
    for part in parts():
        held += part.replace(b"\n", b" ").replace(b"\r", b" ")
        full = len(held) // 80 * 80
        lines = np.empty((full // 80, 82), np.uint8)
        lines[:, :80], lines[:, 80], lines[:, 81] = np.frombuffer(held, np.uint8, full).reshape(-1, 80), 13, 10
        yield lines.tobytes()
        held = held[full:]
    yield held.ljust(80, b"Z") + b"\r\n"
