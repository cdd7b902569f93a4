"""Encoding chains: what a text becomes when it is decoded with a wrong encoding."""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Encodings a text may have been written in or read as.
SINGLE_BYTE = (
    "latin-1", "cp1252", "cp1250", "iso8859-2", "iso8859-15", "iso8859-9", "cp1254", "cp1251", "koi8-r", "iso8859-5",
    "cp866", "cp437", "cp850", "cp852", "mac-roman", "mac-cyrillic", "cp1253", "cp1257",
)
MULTI_BYTE = ("cp932", "euc-jp", "gbk", "big5", "cp949")
#: Those that leave bytes undefined.
GAPS = ("cp1252", "cp1250", "cp1254", "cp1251", "cp1253", "cp1257")
#: Encodings UTF-8 text is commonly read as again and again.
REPEATED = ("latin-1", "cp1252", "cp437", "cp850", "mac-roman", "cp1250", "cp1251")

LOST = "�"


def _table(encoding: str, undefined: str | None = None) -> str:
    """The 256 characters of a one-byte encoding; undefined bytes as given, or as the control characters of their numbers."""
    return "".join(
        bytes([b]).decode(encoding, "ignore") or (chr(b) if undefined is None else undefined) for b in range(256)
    )


def _write(text: str, encoding: str) -> bytes:
    """A text in an encoding, with ``?`` for what it lacks; words have no ``?`` of their own."""
    return text.encode(encoding, "replace")


def _read(data: bytes, encoding: str, lossy: bool, tables: dict = {}) -> str:  # noqa: B006 - kept between calls
    """Bytes read in an encoding: undecodable ones as U+FFFD if lossy, else as they are (one-byte encodings)."""
    if encoding not in SINGLE_BYTE:
        return data.decode(encoding, "replace")
    if (encoding, lossy) not in tables:
        tables[encoding, lossy] = _table(encoding, LOST if lossy else None)
    return codecs.charmap_decode(data, "strict", tables[encoding, lossy])[0]


@dataclass(frozen=True)
class Chain:
    """One or more misreadings: written in ``steps[i][0]``, read as ``steps[i][1]``."""

    steps: tuple[tuple[str, str], ...]
    #: How undecodable bytes are read: as U+FFFD, so that what stood there is lost, or as the control character of their number.
    lost: bool
    #: Whether control characters from 0x80 to 0x9F were dropped after each reading.
    dropped: bool = False

    @property
    def name(self) -> str:
        return ", ".join(f"{a} read as {b}" for a, b in self.steps) + (", controls dropped" if self.dropped else "")


def chains() -> list[Chain]:
    """All chains: every pair of encodings once, and UTF-8 read wrongly two or three times."""
    names = ("utf-8", *SINGLE_BYTE, *MULTI_BYTE)
    out = []
    for a in names:
        for b in names:
            if a != b:
                if b in SINGLE_BYTE:
                    out.append(Chain(((a, b),), False))
                if b not in SINGLE_BYTE or b in GAPS:
                    out.append(Chain(((a, b),), True))
    for a in REPEATED:
        for b in REPEATED:
            out.append(Chain((("utf-8", a), ("utf-8", b)), False))
        out.append(Chain((("utf-8", a),) * 3, False))
    for a in ("latin-1", "cp1252"):
        out += [Chain((("utf-8", a),) * n, False, dropped=True) for n in (1, 2, 3)]
    return out


_CONTROLS = re.compile("[\x80-\x9f]")


def garbled_forms(words: list[str], every: list[Chain]) -> Iterator[tuple[Chain, list[int], list[str]]]:
    """For each chain the numbers of the words it changes, and their garbled forms.

    All words that an encoding can write go through a codec in one call, a line each.
    """
    joined = "\n".join(words)
    written: dict[str, tuple[list[int], bytes]] = {}
    for c in every:
        first = c.steps[0][0]
        if first not in written:
            lines = _write(joined, first).split(b"\n")
            own = [i for i, x in enumerate(lines) if b"?" not in x]
            written[first] = own, b"\n".join(lines[i] for i in own)
        own, data = written[first]
        if not own:
            continue
        text = ""
        for k, (a, b) in enumerate(c.steps):
            if k:
                data = _write(text, a)
            text = _read(data, b, c.lost)
            if c.dropped:
                text = _CONTROLS.sub("", text)
        forms = text.split("\n")
        if len(forms) != len(own):  # a line end was swallowed: word by word
            forms = [garble(words[i], c) for i in own]
        changed = [(i, f) for i, f in zip(own, forms, strict=True) if f != words[i] and f]
        yield c, [i for i, _ in changed], [f for _, f in changed]


def garble(text: str, chain: Chain) -> str:
    """One text under one chain; contains ``?`` where an encoding can't write it."""
    for a, b in chain.steps:
        text = _read(_write(text, a), b, chain.lost)
        if chain.dropped:
            text = _CONTROLS.sub("", text)
    return text


def restore(text: str, chain: Chain) -> str | None:
    """What a garbled text was before, None if something was lost or the chain can't have made it."""
    if chain.dropped or LOST in text:
        return None
    back = text
    try:
        for a, b in reversed(chain.steps):
            back = _bytes(back, b).decode(a)
    except UnicodeError:
        return None
    return back if back != text and LOST not in back and garble(back, chain) == text else None


@functools.cache
def _codes(encoding: str) -> dict[int, int]:
    """The byte of each character of a one-byte encoding, undefined bytes as their control characters."""
    out: dict[int, int] = {}
    for b, c in enumerate(_table(encoding)):
        out.setdefault(ord(c), b)
    return out


def _bytes(text: str, encoding: str) -> bytes:
    """The bytes an encoding reads as a text; UnicodeError if it reads nothing so."""
    if encoding not in SINGLE_BYTE:
        return text.encode(encoding)
    return codecs.charmap_encode(text, "strict", _codes(encoding))[0]
