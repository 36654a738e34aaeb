"""Map extracts as a data source: JSON documents of any size, split by bytes, with the place of every element.

A raw line break never lies inside a JSON string, so a split begins behind one and looks for objects that are elements: a
type of node, way or relation, and a whole number as id. An element belongs to the split in which it begins. A document
on one line is one split, read piece by piece. ``ord`` is (file, block, place): it orders elements over all files by name,
and by place within each, whatever order the files are read in.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import schemas

SPLIT_BYTES, PIECE = 64 << 20, 1 << 20
KINDS = ("node", "way", "relation")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|\{', re.DOTALL)
_HEAD = re.compile(r'"elements"\s*:\s*\[|"type"\s*:\s*"(?:node|way|relation)"')

# Workers get this module along with the source, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Block(InputPartition):
    file: str
    begin: int
    end: int


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _cut(stream, at: int, size: int) -> int:
    """The first place from ``at`` on where a line begins; the end where none does."""
    if at <= 0:
        return 0
    stream.seek(at - 1)
    while piece := stream.read(PIECE):
        if (found := piece.find(b"\n")) >= 0:
            return stream.tell() - len(piece) + found + 1
    return size


def elements(stream, begin: int, end: int, size: int) -> Iterator[dict]:
    """The elements that begin in the lines of [begin, end)."""
    begin, end = _cut(stream, begin, size), _cut(stream, end, size) if end < size else size
    if begin >= end:
        return
    stream.seek(begin)
    decode, parse = codecs.getincrementaldecoder("utf-8")("replace").decode, json.JSONDecoder().raw_decode
    # base: characters let go before ``text``; limit: those of the split, once it is read to its end
    text, base, at, left, limit = "", 0, 0, end - begin, None

    def more() -> bool:
        nonlocal text, base, at, left, limit
        n = max(PIECE, len(text))
        piece = stream.read(min(n, left) if left else n)
        text, base, at, left = text[at:] + decode(piece, not piece), base + at, 0, max(0, left - len(piece))
        if limit is None and not left:
            limit = base + len(text)
        return bool(piece)

    more()
    if begin == 0:
        while not (head := _HEAD.search(text)) and more():
            pass
        at = head.end() if head and head[0].endswith("[") else 0
    while True:
        token = _TOKEN.search(text, at)
        if token is None:
            if limit is not None or not more():
                return
        elif limit is not None and base + token.start() >= limit:
            return
        elif token[0] == "{":
            try:
                found, at = parse(text, token.start())
            except json.JSONDecodeError:
                at = token.start()
                if not more():
                    raise
                continue
            if found.get("type") in KINDS and type(found.get("id")) is int:
                yield found
        elif token[1]:
            at = token.end()
        else:  # a string that the piece cuts off
            at = token.start()
            if not more():
                return


class ExtractReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.kinds = set(options.get("kinds", ",".join(KINDS)).split(","))

    def partitions(self) -> list[Block]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [x for x in store.get_file_info(pafs.FileSelector(path)) if x.is_file and x.base_name[0] not in "._"]
        return [Block(x.path, s, min(x.size, s + self.split)) for x in sorted(files, key=lambda x: x.path) for s in range(0, x.size, self.split)]

    def read(self, partition: Block) -> Iterator[tuple]:
        store, _ = _store(self.path)
        size = store.get_file_info(partition.file).size
        with store.open_input_file(partition.file) as stream:
            for place, e in enumerate(elements(stream, partition.begin, partition.end, size)):
                if e["type"] in self.kinds:
                    number = lambda c, e=e: None if e.get(c) is None else float(e[c])
                    tags, members = e.get("tags"), e.get("members")
                    yield (
                        e["type"], e["id"], number("lat"), number("lon"), e.get("nodes"), None if tags is None else {k: None if v is None else str(v) for k, v in tags.items()},
                        None if members is None else [(m.get("type"), m.get("ref"), m.get("role")) for m in members], (partition.file, partition.begin, place),
                    )


class ExtractSource(DataSource):
    """``spark.read.format("map_extract")`` with a file or a folder, and the options ``splitBytes`` and ``kinds``.

    Filters are not pushed down: two scans of one such frame in a plan share what was pushed last (Spark 4.1), and the
    other one loses rows. Name the ``kinds`` of elements instead, or read an extract once into a table (``osm.read_extract``).
    """

    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return f"{schemas.EXTRACT}, ord {schemas.ORD}"

    def reader(self, schema) -> ExtractReader:
        return ExtractReader(self.options)


@cache
def _registered(app: str) -> None:
    SparkSession.active().dataSource.register(ExtractSource)


def read_documents(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The elements of the JSON documents at ``path``, a file or a folder, in splits of so many bytes."""
    _registered(spark.sparkContext.applicationId)
    return spark.read.format("map_extract").option("splitBytes", split_bytes).option("kinds", ",".join(kinds)).load(path)
