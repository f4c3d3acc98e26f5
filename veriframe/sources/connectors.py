"""Boundary to what Spark doesn't do: image readers and language models, as injectable functions.

A reader takes an image's bytes and gives lines; it runs in ``mapInPandas``, made once for each worker. One with a method ``stream`` takes an
open file there, and need not hold it whole.
No reader for real images is part of this package; ``register_reader`` adds one.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame

LINES = "record_id string, line_id int, text string, confidence double, y_center double, x_min double, y_min double, y_max double, x_max double"
Reader = Callable[[bytes], Iterable[dict]]
_READERS: dict[str, Callable[[], Reader]] = {}


def register_reader(name: str, factory: Callable[[], Reader]) -> None:
    """factory makes the reader; it is shipped to the workers and called there."""
    _READERS[name] = factory


def reader(name: str) -> Callable[[], Reader]:
    if name not in _READERS:
        raise ValueError(f"unknown reader {name!r}; known: {sorted(_READERS)}")
    return _READERS[name]


#: Bytes of a text that are read at a time.
CHUNK = 1 << 20


def split_text(file: BinaryIO, chunk: int = CHUNK) -> Iterator[str]:
    """The lines of a text, as ``splitlines`` gives them; one line and a chunk are held at a time."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    while data := file.read(chunk):
        # the last piece may go on, and a line end may be cut in two
        *whole, held = (held + decoder.decode(data)).splitlines(keepends=True) or [""]
        for line in whole:
            yield line.splitlines()[0]
    yield from (held + decoder.decode(b"", True)).splitlines()


class _TextLines:
    """A reader for images that are plain text: a line of text is a line of the image."""

    def __call__(self, data: bytes) -> Iterator[dict]:
        return self._placed(data.decode("utf-8", "replace").splitlines())

    def stream(self, file: BinaryIO) -> Iterator[dict]:
        return self._placed(split_text(file))

    def _placed(self, lines: Iterable[str]) -> Iterator[dict]:
        for i, t in enumerate(lines):
            yield {"text": t, "confidence": 0.85, "y_center": 40.0 * i + 10, "x_min": 0.0, "y_min": 40.0 * i, "y_max": 40.0 * i + 20, "x_max": 8.0 * len(t)}


register_reader("text", _TextLines)


def read_images(images: DataFrame, name: str) -> DataFrame:
    """Lines of images as the binaryFile source gives them (path, content); record_id is the path."""
    factory = reader(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        columns = [c.split()[0] for c in LINES.split(", ")]
        for b in batches:
            rows = [{"record_id": p, "line_id": i, **line} for p, data in zip(b["path"], b["content"], strict=True) for i, line in enumerate(read(bytes(data)))]
            yield pd.DataFrame(rows, columns=columns)

    return images.select("path", "content").mapInPandas(run, LINES)


def detections(df: DataFrame) -> DataFrame:
    """Adds text and confidence from detection (JSON: [box, text, confidence] or [box, text], then .85); else fails."""
    from pyspark.sql import functions as F

    items = F.from_json("detection", "array<string>")
    conf = F.when(F.size(items) == 3, items[2].cast("double")).when(F.size(items) == 2, F.lit(0.85)).otherwise(F.raise_error(F.lit("a detection has two or three items")))
    return df.withColumns({"text": items[1], "confidence": conf})
