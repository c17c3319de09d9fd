"""SAS transport files, versions 5 and 8."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable

import numpy as np

from statloom.sources.model import Fixed, StatFile, Stored, Variable, unpack_at

_CARD = 80


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """IBM hexadecimal floating point, big-endian 8 bytes; missing values (a lone first byte) are NaN."""
    bits = raw.view(">u8").astype(np.uint64).ravel()
    fraction = (bits & np.uint64((1 << 56) - 1)).astype(float)
    power = ((bits >> np.uint64(56)) & np.uint64(0x7F)).astype(int) - 64
    out = np.ldexp(fraction, 4 * power - 56) * np.where(bits >> np.uint64(63), -1.0, 1.0)
    return np.where((fraction == 0) & (bits != 0) & (bits != np.uint64(1 << 63)), np.nan, out)


def float_to_ibm(x: float) -> bytes:
    if x != x:
        return b".\0\0\0\0\0\0\0"
    if x == 0 or math.isinf(x):
        return bytes(8) if x == 0 else b".\0\0\0\0\0\0\0"
    mantissa, exponent = math.frexp(abs(x))
    power = -(-exponent // 4)
    fraction = round(math.ldexp(mantissa, exponent - 4 * power + 56))
    if fraction >> 56:
        fraction, power = fraction >> 4, power + 1
    if not -64 <= power < 64:
        return b".\0\0\0\0\0\0\0"
    return struct.pack(">Q", (x < 0) << 63 | (power + 64) << 56 | fraction)


def floats_to_ibm(x: np.ndarray) -> bytes:
    """float_to_ibm() of each; 56 bits hold the 53 of any double."""
    mantissa, exponent = np.frexp(np.where(np.isfinite(x), np.abs(x), 0))
    power = -(-exponent.astype(int) // 4)
    fraction = np.ldexp(mantissa, exponent - 4 * power + 56).astype(np.uint64)
    bits = (x < 0).astype(np.uint64) << np.uint64(63) | (power + 64).astype(np.uint64) << np.uint64(56) | fraction
    bits = np.where(x == 0, np.uint64(0), bits)
    return np.where(np.isfinite(x) & (power >= -64) & (power < 64), bits, np.uint64(ord(".") << 56)).astype(">u8").tobytes()


def _header(name: str, rest: str = "0" * 30) -> bytes:
    return f"HEADER RECORD*******{name:<8}HEADER RECORD!!!!!!!{rest:<30}  ".encode()


def read(data: bytes | Stored, encoding: str = "utf-8", header_only: bool = False) -> StatFile:
    def text(b: bytes) -> str:
        return b.decode(encoding, "replace").rstrip(" \0")

    def card(at: int, *names: str) -> str:
        got = data[at : at + _CARD]
        for n in names:
            if got.startswith(f"HEADER RECORD*******{n:<8}HEADER RECORD!!!!!!!".encode()):
                return n
        raise ValueError(f"not a SAS transport file: no {names[0]} header at byte {at}")

    new = card(0, "LIBRARY", "LIBV8") == "LIBV8"
    at = 3 * _CARD
    card(at, "MEMBV8" if new else "MEMBER")
    size = int(data[at + 74 : at + 78] or b"140") or 140
    at += _CARD
    card(at, "DSCPTV8" if new else "DSCRPTR")
    label = text(data[at + 2 * _CARD + 32 : at + 2 * _CARD + 72])
    at += 3 * _CARD
    card(at, "NAMSTV8" if new else "NAMESTR")
    count = int(data[at + 52 : at + 58])
    at += _CARD
    variables, places = [], []
    for k in range(count):
        kind, _, width, _, name, var_label, fmt, fl, fd = unpack_at(">4h8s40s8s2h", data, at + k * size)
        (place,) = unpack_at(">i", data, at + k * size + 84)
        if new:
            name = data[at + k * size + 88 : at + k * size + 120]
        shown = text(fmt) + (str(fl) if fl else "") + (f".{fd}" if fd else "." if text(fmt) else "")
        variables.append(Variable(text(name), "DOUBLE" if kind == 1 else "STRING", shown, text(var_label), width))
        places.append(place)
    at += -(-count * size // _CARD) * _CARD
    if new and data[at : at + 28].rstrip() in (b"HEADER RECORD*******LABELV8", b"HEADER RECORD*******LABELV9"):
        nine = data[at + 20 : at + 27] == b"LABELV9"
        start, n = at + _CARD, int(data[at + 48 : at + 58].split()[0])
        at = start
        for _ in range(n):
            sizes = unpack_at(">5h" if nine else ">3h", data, at)
            at += 10 if nine else 6
            name = at + sizes[1]
            variables[sizes[0] - 1].label = text(data[name : name + sizes[2]])
            at += sum(sizes[1:])
        at = start + -(-(at - start) // _CARD) * _CARD
    card(at, "OBSV8" if new else "OBS")
    out = StatFile("xpt", variables, label=label)
    told = data[at + 48 : at + 63].strip() if new else b""
    at += _CARD
    row = sum(v.width for v in variables)
    n = (len(data) - at) // row if row else 0
    if told.isdigit() and int(told) <= n:
        n = int(told)
    else:  # the last card is filled up with blanks
        while n and row < _CARD and (len(data) - at - (n - 1) * row) <= _CARD and data[at + (n - 1) * row : at + n * row] == b" " * row and (n - 1) * row > len(data) - at - _CARD:
            n -= 1

    def columns(raw: bytes) -> list[np.ndarray]:
        table, found = np.frombuffer(raw, np.uint8).reshape(-1, row), []
        for v, p in zip(variables, places):
            own = np.ascontiguousarray(table[:, p : p + v.width])
            if v.type == "STRING":
                found.append(np.array([text(b.tobytes()) for b in own] or [], object))
            else:
                found.append(ibm_to_float(np.ascontiguousarray(np.pad(own, ((0, 0), (0, 8 - v.width))))) if len(own) else np.zeros(0))
        return found

    if row:
        out.fixed = Fixed(at, row, n, columns)
    if not header_only and row:
        out.columns = columns(data[at : at + n * row])
    return out


def block(variables: list[Variable], columns: list) -> bytes:
    """Rows from columns of numbers and lists of encoded texts."""
    n = len(columns[0])
    out = np.empty((n, sum(v.width for v in variables)), np.uint8)
    place = 0
    for v, c in zip(variables, columns):
        raw = b"".join(x[: v.width].ljust(v.width) for x in c) if v.type == "STRING" else floats_to_ibm(c)
        out[:, place : place + v.width] = np.frombuffer(raw, np.uint8).reshape(n, v.width)
        place += v.width
    return out.tobytes()


def write(variables: list[Variable], blocks: Iterable[bytes], count: int, *, version: int = 5, label: str = "", table: str = "DATASET"):
    """Chunks of the file's bytes; ``blocks`` are rows as block() makes them."""
    new, stamp = version == 8, "01JAN60:00:00:00"
    yield _header("LIBV8" if new else "LIBRARY")
    yield f"{'SAS':<8}{'SAS':<8}{'SASLIB':<8}{'9.4':<8}{'':<8}{'':<24}{stamp}".encode()
    yield f"{stamp:<80}".encode()
    yield _header("MEMBV8" if new else "MEMBER", "000000000000000001600000000140")
    yield _header("DSCPTV8" if new else "DSCRPTR")
    yield f"{'SAS':<8}{table:<{32 if new else 8}}{'SASDATA':<8}{'9.4':<8}{'':<8}{'':<{0 if new else 24}}{stamp}".encode()
    yield f"{stamp:<16}{'':<16}".encode() + label.encode()[:40].ljust(40) + b" " * 8
    yield _header("NAMSTV8" if new else "NAMESTR", f"000000{len(variables):04d}{'0' * 20}")
    place, records = 0, b""
    for k, v in enumerate(variables, 1):
        base, _, rest = v.format.partition(".")
        letters = base.rstrip("0123456789")
        records += struct.pack(">4h", 2 if v.type == "STRING" else 1, 0, v.width, k) + v.name.encode()[:8].ljust(8) + v.label.encode()[:40].ljust(40)
        records += letters.encode()[:8].ljust(8) + struct.pack(">4h", int(base[len(letters) :] or 0), int(rest or 0), 0, 0) + b" " * 8 + struct.pack(">2hi", 0, 0, place)
        records += v.name.encode().ljust(32) + struct.pack(">h", len(v.label.encode())) + bytes(18) if new else bytes(52)
        place += v.width
    yield records + b" " * (-len(records) % _CARD)
    long = [(k, v) for k, v in enumerate(variables, 1) if len(v.label.encode()) > 40]
    if new and long:
        yield _header("LABELV8", f"{len(long):<30}")
        body = b"".join(struct.pack(">3h", k, len(v.name.encode()), len(v.label.encode())) + v.name.encode() + v.label.encode() for k, v in long)
        yield body + b" " * (-len(body) % _CARD)
    yield _header("OBSV8", f"{count:>15}{'':<15}") if new else _header("OBS")
    size = 0
    for out in blocks:
        size += len(out)
        yield out
    yield b" " * (-size % _CARD)
