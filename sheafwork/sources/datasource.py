"""Files as a data source of Spark's own kind, and parsers of the user as table functions of SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.functions import udtf

#: The source's name for spark.read.format(), and Spark's option that lets such sources see filters.
FORMAT, PUSHDOWN = "sheafwork", "spark.sql.python.filterPushdown.enabled"
_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
}


def _system(path: str):
    import pyarrow.fs as fs

    uri = f"s3://{path[6:]}" if path.startswith("s3a://") else path
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"/{uri}")


class _Files(InputPartition):
    def __init__(self, files: list[tuple]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    """Plans partitions by the files' sizes: a task opens files of about so many bytes together, or one that is larger."""

    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes, self.tests = path, partition_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("suffix",), ("size",), ("name",)):
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        import pyarrow.fs as fs

        system, base = _system(self.path)
        parts, own, sizes = [], [], 0
        for info in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            dot = info.base_name.rfind(".")
            known = {"name": info.base_name, "suffix": info.base_name[dot:].lower() if dot >= 0 and dot + 1 < len(info.base_name) else "", "size": info.size}
            if not all(test(known[column], value) for column, test, value in self.tests):
                continue
            if own and sizes + info.size > self.partition_bytes:
                parts.append(_Files(own))
                own, sizes = [], 0
            own.append((info.path, known["name"], known["suffix"], info.size, info.mtime))
            sizes += info.size
        return [*parts, _Files(own)] if own else parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for path, name, suffix, size, modified in partition.files:
            with system.open_input_stream(path, compression=None) as f:
                yield path, name, suffix, size, modified, f.read()


class FileSource(DataSource):
    """spark.read.format("sheafwork").load(folder): path, name, suffix, size, modified, content of all files below a folder, empty ones too; hidden ones (., _) aren't read.

    Option partitionBytes (64 MiB): about how much a task reads. Filters on suffix, size and name are taken while partitions are planned, so files that they rule out are never opened.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, name string, suffix string, size long, modified timestamp, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("partitionbytes", self.options.get("partitionBytes", 64 << 20))))


def read_folder(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """The files of a folder by this source, registered where the session doesn't know it; what detect() and parse() take."""
    spark.dataSource.register(FileSource)
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(FORMAT).option("partitionBytes", partition_bytes).load(path)


def register_table_parser(spark: SparkSession, name: str, parse: Callable[[bytes], Iterable[tuple[str, str | None]]]) -> None:
    """A parser of the user as a table function of SQL: ``name(content)`` gives nth, key, value and error.

    ``parse`` takes a file's bytes and gives keys and values. If it fails, what it gave before stays and one more row says why; null contents give no rows.
    """

    class Parser:
        def eval(self, content):
            nth = 0
            if content is not None:
                try:
                    for key, value in parse(bytes(content)):
                        yield nth, key, value, None
                        nth += 1
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed task
                    yield nth, None, None, f"{type(e).__name__}: {e}"

    spark.udtf.register(name, udtf(Parser, returnType="nth int, key string, value string, error string"))
