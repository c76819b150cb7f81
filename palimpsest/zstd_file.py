"""Compression of whole files beside the originals."""

from __future__ import annotations

import os
from pathlib import Path

import zstandard

from .errors import CompressError

SUFFIX = ".zst"


def _stream(source: Path, target: Path, copy) -> Path:
    """Written beside the target, then renamed."""
    aside = target.with_name(f"{target.name}.{os.getpid()}.tmp")
    try:
        with source.open("rb") as a, aside.open("wb") as b:
            copy(a, b)
        os.replace(aside, target)
    except zstandard.ZstdError as e:
        raise CompressError(f"{source}: {e}") from None
    finally:
        aside.unlink(missing_ok=True)
    return target


def compress(path: str, level: int = 3) -> Path:
    """Writes path.zst; the file stays. Compressed files aren't compressed again."""
    source = Path(path)
    if source.suffix == SUFFIX:
        raise CompressError(f"{path}: compressed already")
    if not 1 <= level <= 22:
        raise CompressError(f"level {level}: not from 1 to 22")
    return _stream(source, source.with_name(source.name + SUFFIX), zstandard.ZstdCompressor(level=level).copy_stream)


def decompress(path: str) -> Path:
    """Writes the file without .zst; the compressed one stays."""
    source = Path(path)
    if source.suffix != SUFFIX:
        raise CompressError(f"{path}: not a {SUFFIX} file")
    return _stream(source, source.with_suffix(""), zstandard.ZstdDecompressor().copy_stream)
