"""Binary workbooks of the 1997 format: streams of a compound file, and the cells in their records.

Both layouts are public: a compound file is a small file system of sectors in chains, a workbook stream is a sequence
of records of a type, a length and their data.
"""

from __future__ import annotations

import struct

#: Fixed values of the formats: the signature, marks in the sector table, and the types of records read here.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
CHAIN_END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
BOF, EOF, SHEET, STRINGS, MORE = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C
SHARED, NUMBER, PACKED, PACKED_ROW, LABEL, FLAG, FORMULA, RESULT = 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0204, 0x0205, 0x0006, 0x0207


class CompoundFile:
    def __init__(self, data: bytes) -> None:
        if data[:8] != SIGNATURE:
            raise ValueError("no compound file")
        self.data, self.size = data, 1 << struct.unpack_from("<H", data, 30)[0]
        count, directory, self.cutoff, small = struct.unpack_from("<I", data, 44)[0], *struct.unpack_from("<I", data, 48), *struct.unpack_from("<I", data, 56), struct.unpack_from("<I", data, 60)[0]
        tables = [s for s in struct.unpack_from("<109I", data, 76) if s < CHAIN_END]
        further = struct.unpack_from("<I", data, 68)[0]
        while further < CHAIN_END and len(tables) < count:
            *more, further = struct.unpack(f"<{self.size // 4}I", self.sector(further))
            tables += [s for s in more if s < CHAIN_END]
        self.next = [n for s in tables[:count] for n in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        self.entries = {}
        listed = self.chain(directory)
        for at in range(0, len(listed) - 127, 128):
            length, kind = struct.unpack_from("<HB", listed, at + 64)
            if kind:
                name = listed[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")
                self.entries[name] = (kind, *struct.unpack_from("<II", listed, at + 116))
        root = next((e for e in self.entries.values() if e[0] == 5), None)
        self.mini = self.chain(root[1]) if root and root[1] < CHAIN_END else b""
        self.mini_next = struct.unpack(f"<{len(self.chain(small)) // 4}I", self.chain(small)) if small < CHAIN_END else ()

    def sector(self, number: int) -> bytes:
        return self.data[(number + 1) * self.size :][: self.size].ljust(self.size, b"\0")

    def chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < CHAIN_END and start not in seen and start < len(self.next):
            seen.add(start)
            out.append(self.sector(start))
            start = self.next[start]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        _, start, size = self.entries[name]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, seen = [], set()
        while start < len(self.mini_next) and start not in seen:
            seen.add(start)
            out.append(self.mini[start * 64 : start * 64 + 64])
            start = self.mini_next[start]
        return b"".join(out)[:size]


def records(stream: bytes, at: int = 0):
    """``type, data, next`` of the records from a place on."""
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + size], at + 4 + size
        at += 4 + size


def chars(data: bytes, count: int, wide: bool) -> str:
    return data[: 2 * count].decode("utf-16-le", "replace") if wide else data[:count].decode("latin-1")


def shared_strings(parts: list[bytes]) -> list[str]:
    """The table of strings; where one goes on in the next record, that one tells the width of its characters anew."""
    left, at, k = struct.unpack_from("<I", parts[0], 4)[0], 8, 0
    out: list[str] = []
    while len(out) < left:
        while at >= len(parts[k]):
            k, at = k + 1, at - len(parts[k])
            if k == len(parts):
                return out
        count, flags = struct.unpack_from("<HB", parts[k], at)
        at += 3
        runs, extra = 0, 0
        if flags & 8:
            runs, at = struct.unpack_from("<H", parts[k], at)[0], at + 2
        if flags & 4:
            extra, at = struct.unpack_from("<I", parts[k], at)[0], at + 4
        text, wide = "", bool(flags & 1)
        while True:
            some = min(count - len(text), (len(parts[k]) - at) // (2 if wide else 1))
            text += chars(parts[k][at:], some, wide)
            at += some * (2 if wide else 1)
            if len(text) >= count or k + 1 == len(parts):
                break
            k, at = k + 1, 1
            wide = bool(parts[k][0] & 1)
        out.append(text)
        at += 4 * runs + extra
    return out


def packed_number(raw: int) -> float:
    value = float((raw >> 2) - (1 << 30 if raw & 0x80000000 else 0)) if raw & 2 else struct.unpack("<d", struct.pack("<II", 0, raw & 0xFFFFFFFC))[0]
    return value / 100 if raw & 1 else value


def shown(value: float) -> str:
    return str(int(value)) if value == int(value) else str(value)


def cells_of(stream: bytes, start: int, strings: list[str]) -> dict[tuple[int, int], str]:
    """The cells that hold something of the sheet that begins at a place."""
    out: dict[tuple[int, int], str] = {}
    waiting, depth = None, 0
    for kind, data, _ in records(stream, start):
        depth += (kind == BOF) - (kind == EOF)
        if kind == EOF and depth <= 0:
            break
        if kind == RESULT and waiting:
            count, wide = struct.unpack_from("<HB", data)
            out[waiting] = chars(data[3:], count, bool(wide & 1))
        if kind not in (SHARED, NUMBER, PACKED, PACKED_ROW, LABEL, FLAG, FORMULA):
            continue
        row, column = place = struct.unpack_from("<HH", data)
        if kind == SHARED:
            number = struct.unpack_from("<I", data, 6)[0]
            out[place] = strings[number] if number < len(strings) else ""
        elif kind == NUMBER:
            out[place] = shown(struct.unpack_from("<d", data, 6)[0])
        elif kind == PACKED:
            out[place] = shown(packed_number(struct.unpack_from("<I", data, 6)[0]))
        elif kind == PACKED_ROW:
            for i in range((len(data) - 6) // 6):
                out[row, column + i] = shown(packed_number(struct.unpack_from("<I", data, 6 + 6 * i)[0]))
        elif kind == LABEL:
            count, wide = struct.unpack_from("<HB", data, 6)
            out[place] = chars(data[9:], count, bool(wide & 1))
        elif kind == FLAG and not data[7]:
            out[place] = str(bool(data[6]))
        elif kind == FORMULA:
            waiting = place if data[12:14] == b"\xff\xff" and data[6] == 0 else None
            if data[12:14] != b"\xff\xff":
                out[place] = shown(struct.unpack_from("<d", data, 6)[0])
    return {k: v for k, v in out.items() if v != ""}


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """Names and rows of a workbook's sheets; empty cells are left out of a row."""
    file = CompoundFile(data)
    stream = file.stream("Workbook") or file.stream("Book")
    if stream is None:
        raise ValueError("no workbook")
    named, parts, previous = [], [], None
    for kind, body, _ in records(stream):
        if kind == SHEET:
            start, _, kind_, count, wide = struct.unpack_from("<IBBBB", body)
            if not kind_:
                named.append((chars(body[8:], count, bool(wide & 1)), start))
        elif kind == STRINGS or kind == MORE and previous == STRINGS:
            parts.append(body)
        previous = STRINGS if kind == MORE and previous == STRINGS else kind
        if kind == EOF:
            break
    strings = shared_strings(parts) if parts else []
    out = []
    for name, start in named:
        cells = cells_of(stream, start, strings)
        rows: dict[int, list[tuple[int, str]]] = {}
        for (row, column), value in cells.items():
            rows.setdefault(row, []).append((column, value))
        out.append((name, [[v for _, v in sorted(rows[r])] for r in sorted(rows)]))
    return out
