"""Settings files: four sections of keys, with typed getters, as a frozen set of options."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelveil.functions.tables import with_import_path
from pixelveil.operators.neighbourhood import WINDOWS

_TRUE, _FALSE = ("true", "yes", "on", "1"), ("false", "no", "off", "0")


class Settings:
    """Sections and keys in any case; keys that repeat join by line feeds; lines that don't parse are left out.

    Lines that begin with ``;`` or ``#`` are comments, and so is what follows a ``;`` after white space; a ``#`` inside a line is text. What
    stands behind a section's bracket plays no part. An indented line goes on with the value before it.
    """

    def __init__(self, text: str):
        self.values: dict[tuple[str, str], str] = {}
        section, last = "", None
        for raw in text.removeprefix("\ufeff").splitlines():
            line = raw.strip()
            if not line or line[0] in ";#":
                continue
            line = re.split(r"\s;", line, maxsplit=1)[0].rstrip()
            if last and raw[:1] in " \t":
                self._put(last, line)
            elif line[0] == "[":
                if "]" in line:
                    section, last = line[1 : line.index("]")].strip().lower(), None
            elif m := re.match(r"([^=:]*)[=:](.*)", line):
                last = section, m[1].strip().lower()
                self._put(last, m[2].strip())

    def _put(self, at: tuple[str, str], value: str) -> None:
        self.values[at] = f"{self.values[at]}\n{value}" if self.values.get(at) else value

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8-sig") as f:
            return cls(f.read())

    def text(self, section: str, key: str, default: str = "") -> str:
        return self.values.get((section.lower(), key.lower()), default)

    def integer(self, section: str, key: str, default: int) -> int:
        """Decimal, hexadecimal (0x) or octal (a leading 0), as far as the digits go."""
        m = re.match(r"\s*([+-]?)(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9]\d*)", self.text(section, key))
        if not m:
            return default
        base = 16 if m[2][:2] in ("0x", "0X") else 8 if m[2][0] == "0" else 10
        return int(m[1] + m[2], base)

    def number(self, section: str, key: str, default: float) -> float:
        m = re.match(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", self.text(section, key))
        return float(m[0]) if m else default

    def flag(self, section: str, key: str, default: bool) -> bool:
        v = self.text(section, key).lower()
        return True if v in _TRUE else False if v in _FALSE else default


@dataclass(frozen=True)
class Options:
    """What a run needs, checked."""

    p: int = 3
    psnr: float = 40.0
    interval: int = 30
    loops: int = 5
    image: str = ""
    video: str = ""
    signal: str = ""
    encode_to: str = ""
    detection: bool = False

    def __post_init__(self):
        if self.p not in WINDOWS:
            raise ValueError(f"p must be one of {WINDOWS}")
        if not self.psnr > 0:
            raise ValueError("psnr must be positive")
        if self.interval < 1:
            raise ValueError("the interval must be positive")
        if self.loops < 1:
            object.__setattr__(self, "loops", 5)


def options(s: Settings) -> Options:
    """Options from a file's sections; absent keys keep their defaults. Sections ``video`` and short keys are read too."""
    d = Options()

    def first(get, default, *places):
        for section, key in reversed(places):
            default = get(section, key, default)
        return default

    return Options(
        p=s.integer("parameters", "p", d.p), psnr=s.number("parameters", "psnr", d.psnr),
        loops=first(s.integer, d.loops, ("parameters", "loops_for_test"), ("parameters", "loops")),
        interval=first(s.integer, d.interval, ("parameters_video", "watermark_interval"), ("video", "interval")),
        encode_to=first(s.text, d.encode_to, ("parameters_video", "encode_watermark_file_path"), ("video", "encode_to")),
        detection=first(s.flag, d.detection, ("parameters_video", "watermark_detection"), ("video", "detection")),
        image=s.text("paths", "image"), video=s.text("paths", "video"), signal=first(s.text, d.signal, ("paths", "watermark"), ("paths", "signal")),
    )


def read_settings(texts: DataFrame) -> DataFrame:
    """``(source, section, key, value)`` of settings texts ``(source, text)``, one row per key; sections and keys in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(source, *at, value) for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for at, value in Settings(text or "").values.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["source", "section", "key", "value"])

    with_import_path(texts.sparkSession)
    return texts.select("source", "text").mapInArrow(run, "source string, section string, key string, value string")


def as_integer(value: Column) -> Column:
    """``Settings.integer`` of a value column, null where there is none."""
    sign, digits = F.regexp_extract(value, r"^\s*([+-]?)", 1), F.regexp_extract(value, r"^\s*[+-]?(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)", 1)
    number = F.when(F.lower(digits).startswith("0x"), F.conv(F.substring(digits, 3, 64), 16, 10)).when(digits.startswith("0"), F.conv(digits, 8, 10)).otherwise(digits)
    return F.when(digits != "", F.concat(sign, number).cast("bigint"))


def as_flag(value: Column) -> Column:
    """``Settings.flag`` of a value column, null where it is neither."""
    return F.when(F.lower(value).isin(*_TRUE), True).when(F.lower(value).isin(*_FALSE), False)
