"""Extraction files as a Python data source: records with a schema check, faults as rows, files listed in the tasks."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Where the records may stand in an extraction file, by the first key that is there.
LAYOUTS = ("extraction", "experiments", "extracted_data")
_KINDS = {"str": "string", "int": "long", "float": "double", "bool": "boolean"}


def _checked(record: object, fields: dict[str, str]) -> tuple[list, str | None]:
    """Values of the fields and what is wrong; a whole float is an int, an int a float, and a number's text what it says."""
    if not isinstance(record, dict):
        return [None] * len(fields), "record: not an object"
    out, problem = [], None
    for name, kind in fields.items():
        value, required = record.get(name), kind.endswith("!")
        kind, good = kind.rstrip("!"), None
        if value is None:
            problem = problem or (f"{name}: missing" if required else None)
        elif kind == "str":
            good = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        elif kind == "bool":
            good = value if isinstance(value, bool) else None
        elif not isinstance(value, bool):
            try:
                number = float(value)
                good = number if kind == "float" else int(value) if number.is_integer() and abs(number) < 2**63 else None
                good = None if isinstance(good, float) and not math.isfinite(good) else good
            except (TypeError, ValueError, OverflowError):
                good = None
        if value is not None and good is None:
            problem = problem or f"{name}: no {kind}"
        out.append(good)
    return out, problem


def _records(text: str) -> list:
    data = json.loads(text)
    if isinstance(data, dict):
        first = next((k for k in LAYOUTS if k in data), None)
        if first is None:
            raise ValueError("no records")
        data = data[first] if first == "experiments" else (data[first] or {}).get("experiments")
    if not isinstance(data, list):
        raise ValueError("no records")
    return data


class _Part(InputPartition):
    def __init__(self, number: int, of: int):
        super().__init__(number)
        self.number, self.of = number, of


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.parts, self.suffix = options["path"], int(options.get("partitions", "8")), options.get("suffix", ".json")
        self.fields, self.lines = json.loads(options.get("fields", "{}")), options.get("lines", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Part(i, self.parts) for i in range(self.parts)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        """Each task lists the folder by names only and reads the files that fall to it."""
        import zlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.base_name
            if info.type != fs.FileType.File or not name.endswith(self.suffix) or name.startswith(("_", ".")) or zlib.crc32(info.path.encode()) % partition.of != partition.number:
                continue
            with store.open_input_stream(info.path) as stream:
                data = stream.read()
            key = name.removesuffix(self.suffix)
            pieces = data.split(b"\n") if self.lines else [data]
            for place, piece in enumerate(pieces):
                if piece.strip():
                    yield from self._rows(f"{key}:{place}" if self.lines else key, piece)

    def _rows(self, key: str, data: bytes) -> Iterator[tuple]:
        none = [None] * len(self.fields)
        try:
            text = data.decode("utf-8")
            records = _records(text)
        except (ValueError, AttributeError) as error:
            yield (key, None, *none, data.decode("utf-8", "replace"), f"file: {type(error).__name__}")
            return
        for i, record in enumerate(records):
            values, problem = _checked(record, self.fields)
            yield (key, i, *values, json.dumps(record, ensure_ascii=False) if problem else None, problem)


class Extractions(DataSource):
    """``spark.read.format("extractions").option("fields", '{"ph": "float", "formula": "str!"}').load(folder)``

    (doc_key, pos, fields, _corrupt, _problem), a row for each record of each file.  Kinds: str, int, float, bool; ``!`` for required ones.  A
    record that does not fit stands with what is wrong, its text, and null for the values at fault; so does a file that is no
    JSON or has no records, with a null pos.  ``lines``: each line is a file of its own, with doc_key file:line.  ``partitions``: tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "extractions"

    def schema(self) -> str:
        fields = json.loads(self.options.get("fields", "{}"))
        return ", ".join(["doc_key string", "pos long", *[f"`{n}` {_KINDS[k.rstrip('!')]}" for n, k in fields.items()], "_corrupt string", "_problem string"])

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Extractions)
