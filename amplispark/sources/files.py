"""Which input files there are, what format they have, and their bytes."""

from __future__ import annotations

import fnmatch
import glob
import logging
import os
import zlib
from collections.abc import Iterable, Iterator

from pyarrow import fs

from amplispark.errors import DecompressionLimitExceeded, LineTooLong
from amplispark.functions.dna import FASTA_EXTENSIONS, GENBANK_EXTENSIONS

LOG = logging.getLogger("amplispark")
DEFAULT_LIMIT = 4 << 30


def is_gzipped(path: str) -> bool:
    return path.lower().endswith(".gz")


def detect_format(path: str) -> str | None:
    """fasta, genbank or None, by the extension after one .gz is taken off."""
    name = os.path.basename(path).lower().removesuffix(".gz")
    stem, dot, ext = name.rpartition(".")
    if not dot or not stem:
        return None
    return "fasta" if ext in FASTA_EXTENSIONS else "genbank" if ext in GENBANK_EXTENSIONS else None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def size_of(path: str) -> int:
    store, at = _store(path)
    return store.get_file_info(at).size


def _is_file(path: str) -> bool:
    store, at = _store(path)
    return store.get_file_info(at).type == fs.FileType.File


def _matching(pattern: str) -> list[str]:
    """Files that match a pattern, sorted. Of a URI only the last part may be a pattern."""
    if "://" not in pattern:
        return sorted(h for h in glob.glob(pattern) if os.path.isfile(h))
    folder, _, name = pattern.rpartition("/")
    store, at = _store(folder)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f"{folder}/{f.base_name}" for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, name))


def is_bgzf(path: str) -> bool:
    """Whether the file begins with a gzip member that has BGZF's extra field."""
    store, at = _store(path)
    with store.open_input_stream(at, compression=None) as f:
        head = f.read(18)
    return len(head) == 18 and head[:2] == b"\x1f\x8b" and bool(head[3] & 4) and head[12:14] == b"BC"


def expand_inputs(patterns: str | Iterable[str]) -> list[str]:
    """Files of the patterns (commas separate them too), each once, in order; unknown formats are left out with a warning.

    A pattern with *, ? or [ may find nothing, which is a warning; another must be a file. Paths may be URIs of any file system that
    pyarrow knows (file, hdfs, s3, gs).
    """
    wanted = [patterns] if isinstance(patterns, str) else list(patterns)
    found: dict[str, None] = {}
    for p in (x.strip() for w in wanted for x in w.split(",")):
        if not p:
            continue
        if any(c in p for c in "*?["):
            hits = _matching(p)
            if not hits:
                LOG.warning("%s matches no file", p)
            found |= dict.fromkeys(hits)
        elif _is_file(p):
            found[p] = None
        else:
            raise FileNotFoundError(p)
    if not found:
        raise FileNotFoundError("No input files found")
    known = [p for p in found if detect_format(p)]
    for p in found.keys() - set(known):
        LOG.warning("%s has no known extension", p)
    if not known:
        raise FileNotFoundError("No supported sequence files found")
    return known


def chunks(path: str, limit: int = DEFAULT_LIMIT, start: int = 0, size: int = 1 << 20) -> Iterator[bytes]:
    """The file's bytes, decompressed if it is gzipped (any number of members). More than `limit` decompressed bytes raise; 0 is no limit."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        f.seek(start)
        if not is_gzipped(path):
            while data := f.read(size):
                yield data
            return
        total, member, data = 0, zlib.decompressobj(31), f.read(size)
        while data:
            out = member.decompress(data, size)
            total += len(out)
            if limit and total > limit:
                raise DecompressionLimitExceeded(f"{path}: more than {limit} bytes")
            if out:
                yield out
            if member.eof:
                data = (member.unused_data or f.read(size)).lstrip(b"\0")
                member = zlib.decompressobj(31) if data else member
            else:
                data = member.unconsumed_tail or f.read(size)
        if not member.eof:
            raise EOFError(f"{path}: the compressed data ends early")


def lines(parts: Iterable[bytes], longest: int | None = None, path: str = "") -> Iterator[bytes]:
    """Lines without their ends (LF or CRLF)."""
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        for line in whole:
            if longest and len(line) > longest:
                raise LineTooLong(f"{path}: a line of more than {longest} bytes")
            yield line.removesuffix(b"\r")
        if longest and len(rest) > longest:
            raise LineTooLong(f"{path}: a line of more than {longest} bytes")
    if rest:
        yield rest.removesuffix(b"\r")
