"""What a photo says of itself: size and EXIF from the head of a JPEG or PNG, no pixel decoded."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bytes that are looked at, the entries of a directory and the characters of a text at most.
HEAD, ENTRIES, LETTERS = 2 << 20, 256, 512
# Numbers of the fields, by directory; bytes of an item of each type.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x8769: "detail", 0x9003: "taken", 0x920A: "focal_mm", 0xA434: "lens"}
SIZES = {2: 1, 3: 2, 4: 4, 5: 8, 10: 8}
FIELDS = {"width": pa.int32(), "height": pa.int32(), "orientation": pa.int32(), "make": pa.string(), "model": pa.string(), "lens": pa.string(), "focal_mm": pa.float64(), "taken": pa.timestamp("us", "UTC")}


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, content) of a JPEG's segments up to its first scan; ends where the file breaks."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # alone, without a length
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            return
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        if length < 2 or at + 2 + length > len(data):
            return
        yield marker, data[at + 4 : at + 2 + length]
        at += 2 + length


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, content) of a PNG's chunks up to its end or where the file breaks."""
    at = 8
    while data[:8] == b"\x89PNG\r\n\x1a\n" and at + 12 <= len(data):
        length = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + length > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        at += 12 + length


def directory(tiff: bytes, order: str, offset: int) -> dict[str, tuple[int, bytes]]:
    """(type, content) of the known fields of one directory; those that lie outside the segment are left out."""
    if offset < 8 or offset + 2 > len(tiff):
        return {}
    (count,) = struct.unpack_from(f"{order}H", tiff, offset)
    if count > ENTRIES or offset + 2 + 12 * count > len(tiff):
        return {}
    out = {}
    for k in range(count):
        entry = offset + 2 + 12 * k
        tag, kind, items = struct.unpack_from(f"{order}HHI", tiff, entry)
        size = SIZES.get(kind, 0) * items
        if tag not in TAGS or not 0 < size <= LETTERS:
            continue
        start = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", tiff, entry + 8)[0]
        if start + size <= len(tiff):
            out[TAGS[tag]] = kind, tiff[start : start + size]
    return out


def exif(segment: bytes) -> dict:
    """The fields of an EXIF segment: those of the first directory and of the one that it names, each read once, so no chain of offsets has an end to look for."""
    tiff = segment[6:]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if segment[:6] != b"Exif\0\0" or order is None or len(tiff) < 8 or struct.unpack_from(f"{order}H", tiff, 2)[0] != 42:
        return {}
    first = directory(tiff, order, struct.unpack_from(f"{order}I", tiff, 4)[0])
    kind, raw = first.pop("detail", (0, b""))
    detail = directory(tiff, order, struct.unpack(f"{order}I", raw)[0]) if kind == 4 and len(raw) == 4 else {}
    out = {}
    for name, (kind, raw) in [*((k, v) for k, v in detail.items() if k in ("taken", "lens", "focal_mm")), *((k, v) for k, v in first.items() if k in ("make", "model", "orientation"))]:
        if name == "orientation":
            if kind == 3 and len(raw) == 2 and 1 <= (turn := struct.unpack(f"{order}H", raw)[0]) <= 8:
                out[name] = turn
        elif name == "focal_mm":
            if kind in (5, 10) and len(raw) == 8:
                above, below = struct.unpack(f"{order}{'II' if kind == 5 else 'ii'}", raw)
                if below and above / below > 0:
                    out[name] = above / below
        elif kind == 2 and (text := raw.decode("latin-1").replace("\0", "").strip()):
            out[name] = text
    if "taken" in out:
        try:
            out["taken"] = datetime.datetime.strptime(out["taken"], "%Y:%m:%d %H:%M:%S").replace(tzinfo=datetime.timezone.utc)
        except ValueError:
            del out["taken"]
    return out


def described(data: bytes | None) -> dict:
    out: dict = {}
    for marker, content in segments((data or b"")[:HEAD]):
        if marker == 0xE1 and "make" not in out and content[:4] == b"Exif":
            out |= exif(content)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(content) >= 5 and "width" not in out:
            out |= {"height": int.from_bytes(content[1:3], "big"), "width": int.from_bytes(content[3:5], "big")}
    for kind, content in chunks((data or b"")[:HEAD]):
        if kind == b"eXIf" and "make" not in out:
            out |= exif(b"Exif\0\0" + content)
        elif kind == b"IHDR" and len(content) >= 8 and "width" not in out:
            width, height = int.from_bytes(content[:4], "big"), int.from_bytes(content[4:8], "big")
            out |= {"width": width, "height": height} if max(width, height) < 1 << 31 else {}  # what the format allows
    return out


def metadata(photos: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys and width, height, orientation, make, model, lens, focal_mm, taken (as UTC) of photos; nulls for what a file doesn't say or says brokenly.

    Only the first 2 MiB of a file are sent to Python; any number of segments is walked.
    """
    fields = ", ".join(f"`{k}` {photos.schema[k].dataType.simpleString()}" for k in keys)
    head = photos.select(*keys, F.substring(F.col(content), 1, HEAD).alias("_head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [described(v.as_py()) for v in rb.column("_head")]
            columns = [pa.array([f.get(name) for f in found], kind) for name, kind in FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*(rb.column(k) for k in keys), *columns], names=[*keys, *FIELDS])

    return head.mapInArrow(run, f"{fields}, width int, height int, orientation int, make string, model string, lens string, focal_mm double, taken timestamp")
