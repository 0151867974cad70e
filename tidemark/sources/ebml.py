"""Elements of EBML, the binary markup below Matroska and WebM: read from a window on a file, and written."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

#: The longest head of an element: four bytes of id and eight of size.
HEAD_BYTES = 12


class Element(NamedTuple):
    """An element's id, where its head begins and its body begins, and its size; None where the size is not given."""

    id: int
    at: int
    body: int
    size: int | None

    @property
    def end(self) -> int | None:
        return None if self.size is None else self.body + self.size


class Window:
    """Reads at any place of an open file, through one remembered stretch, so that neighbouring heads cost one read."""

    def __init__(self, file, size: int, stretch: int = 1 << 18):
        self.file, self.size, self.stretch = file, size, stretch
        self.start, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from at on, fewer where the file ends; none for a place outside it."""
        n = min(n, self.size - at)
        if at < 0 or n <= 0:
            return b""
        if at < self.start or at + n > self.start + len(self.held):
            if n >= self.stretch:
                return self.file.read_at(n, at)
            self.start, self.held = at, self.file.read_at(min(self.stretch, self.size - at), at)
        return self.held[at - self.start : at - self.start + n]


def vint(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(value, length) of a number of variable length, value -1 where all its bits are set; None where there is none."""
    if at >= len(data) or data[at] == 0:
        return None
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        return None
    full = (1 << 7 * length) - 1
    value = int.from_bytes(data[at : at + length], "big") & full
    return (-1 if value == full else value), length


def element_in(data: bytes, at: int, shift: int = 0) -> Element | None:
    """The element whose head is at `at` in data, which begins at shift in its file."""
    if at >= len(data) or data[at] < 16:
        return None
    length = 9 - data[at].bit_length()
    size = vint(data, at + length)
    if size is None:
        return None
    body = shift + at + length + size[1]
    return Element(int.from_bytes(data[at : at + length], "big"), shift + at, body, None if size[0] < 0 else size[0])


def element_at(window: Window, at: int) -> Element | None:
    return element_in(window.read(at, HEAD_BYTES), 0, at)


def elements(window: Window, at: int, end: int) -> Iterator[Element]:
    """Elements one after the other, by their sizes; one of unknown size is the last."""
    while at < end:
        found = element_at(window, at)
        if found is None:
            return
        yield found
        if found.end is None:
            return
        at = found.end


def fields(body: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, value) of the elements in a body that is at hand; the last one may be cut off."""
    at = 0
    while (found := element_in(body, at)) is not None and found.end is not None:
        yield found.id, body[found.body : found.end]
        at = found.end


def number(value: bytes) -> int:
    return int.from_bytes(value, "big")


def text(value: bytes) -> str:
    return value.decode("utf-8", "replace").rstrip("\0")


def size_bytes(size: int, length: int = 0) -> bytes:
    """A size in the fewest bytes, or in length of them."""
    length = length or max(1, ((size + 1).bit_length() + 6) // 7)
    return (size | 1 << 7 * length).to_bytes(length, "big")


def unsigned(value: int, length: int = 0) -> bytes:
    return value.to_bytes(length or max(1, (value.bit_length() + 7) // 8), "big")


def element(id_: int, *parts: bytes, length: int = 0) -> bytes:
    """An element of the parts, its size in length bytes if that is given."""
    body = b"".join(parts)
    return unsigned(id_) + size_bytes(len(body), length) + body
