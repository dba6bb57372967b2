"""A streaming source for text files that someone else is still appending to.

``spark.dataSource.register(GrowingCsv)`` and then ``spark.readStream.format("growing_csv").schema(...).load(folder)``. The offset
of a file is the byte behind its last whole line, so a half-written line waits for its end. A file that is shorter than
what has been read of it was replaced and is read from its start. Offsets are in the stream's checkpoint: after a restart
each line is read once. Long stretches are cut into parts that tasks read side by side; a line belongs to the part in
which it begins.

Files are reached through pyarrow's file systems: local folders, or any URI that it knows. Fields are parted by commas; a field
that is empty or not of its column's type is null, a line that repeats the column names is a header and gives no row, and
missing fields at the end of a line are null. Files that vanish are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructType

_STEP = 1 << 16
PART = 16 << 20


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def whole_lines(source, size: int) -> int:
    """The byte behind the last line break of a file of that size; 0 if there is none."""
    end = size
    while end:
        start = max(0, end - _STEP)
        source.seek(start)
        at = source.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def parts_of(start: dict[str, int], end: dict[str, int], part: int = PART) -> list[tuple[str, int, int, int]]:
    """(file, from, to, begin): the stretches to be read, each file's from where it was left, a shorter file's from 0."""
    out = []
    for name, stop in sorted(end.items()):
        begin = start.get(name, 0)
        begin = 0 if stop < begin else begin
        out += [(name, a, min(a + part, stop), begin) for a in range(begin, stop, part)]
    return out


def lines_of(source, a: int, z: int, begin: int) -> Iterator[bytes]:
    """The lines that begin at a byte from a to before z; begin is where a line surely begins."""
    source.seek(max(begin, a - 1))
    rest = source.read(z - max(begin, a - 1))
    if a > begin:
        cut = rest.find(b"\n")
        if cut < 0:
            return
        rest = rest[cut + 1 :]
    while rest and not rest.endswith(b"\n"):
        more = source.read(_STEP)
        if not more:
            break
        cut = more.find(b"\n")
        rest += more if cut < 0 else more[: cut + 1]
    yield from (x for x in rest.split(b"\n") if x)


def _value(text: str, kind):
    if text == "":
        return None
    try:
        if isinstance(kind, (LongType, IntegerType)):
            return int(text)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(text)
    except ValueError:
        return None
    return text


@dataclass
class Stretch(InputPartition):
    name: str
    a: int
    z: int
    begin: int


class GrowingCsvReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, part: int) -> None:
        self.schema, self.path, self.part = schema, path, part

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = _file_system(self.path)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name.endswith(".csv"):
                with system.open_input_file(info.path) as f:
                    out[info.path] = whole_lines(f, info.size)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Stretch(*x) for x in parts_of(start, end, self.part)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        fields = self.schema.fields
        header = ",".join(f.name for f in fields)
        with system.open_input_file(partition.name) as f:
            for line in lines_of(f, partition.a, partition.z, partition.begin):
                text = line.decode("utf-8", "replace").rstrip("\r")
                if text == header:
                    continue
                cells = text.split(",")
                yield tuple(_value(cells[i], x.dataType) if i < len(cells) else None for i, x in enumerate(fields))

    def commit(self, end: dict) -> None:
        pass


class GrowingCsv(DataSource):
    """Options: path (the folder of the .csv files), partBytes (how many bytes a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "growing_csv"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingCsvReader(schema, self.options["path"], int(self.options.get("partBytes", PART)))
