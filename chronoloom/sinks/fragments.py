"""Documents written as streams of fragments.

A row of a chronology may have any number of lines and places.  Its JSON object, or its line of
the printed table, is a sequence of fragments: what opens it, one per place, one per line, what
closes it.  Fragments of all documents are range-partitioned and sorted, and each task appends
its range to one file per document as the fragments come by.  So no object or line is ever held
as one value; where a range ends inside a line, the next file goes on there.

A task tells which attempt wrote its files, and a run counts once all have: the commit writes
the list of attempts.  Files of attempts that are not on the list are left over and not read.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..rules import Pack
from . import export

LIST = "_attempts.json"
ORDER = ["case_id", "section", "row_sort", "part", "piece", "pos"]


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote."""

    place: int
    attempt: str
    size: int


class FragmentWriter(DataSourceWriter):
    """Appends (document, text) rows, in the order they come, to a file per document and task."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, root = _system(self.path)
        place, attempt, size = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        now, out = None, None
        try:
            for row in iterator:
                if out is None or row["document"] != now:
                    if out is not None:
                        out.close()
                    now = row["document"]
                    folder = f"{root}/{_folder(now)}"
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{self.run}-{place:07d}-{attempt}")
                data = row["text"].encode()
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(place, attempt, size)

    def commit(self, messages: list) -> None:
        """One small record per task; readers look here first."""
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        told = {"run": self.run, "attempts": {m.place: m.attempt for m in messages if m is not None},
                "bytes": sum(m.size for m in messages if m is not None)}
        with system.open_output_stream(f"{root}/{LIST}.{self.run}") as out:
            out.write(json.dumps(told).encode())
        system.move(f"{root}/{LIST}.{self.run}", f"{root}/{LIST}")

    def abort(self, messages: list) -> None:
        """The list still names the run before; nothing to undo."""


class Fragments(DataSource):
    """``df.write.format("fragments").option("path", …)`` for rows (document, text)."""

    @classmethod
    def name(cls) -> str:
        return "fragments"

    def schema(self) -> str:
        return "document string, text string"

    def writer(self, schema, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(self.options["path"])


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        fs.LocalFileSystem(), path)


def _folder(document: str) -> str:
    return "document=" + urllib.parse.quote(document, safe="")


def write(fragments: DataFrame, path: str) -> None:
    """Write documents of fragments (``ORDER`` and text) to a folder that all machines share."""
    spark = fragments.sparkSession
    spark.dataSource.register(Fragments)
    fragments.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(
        F.col("case_id").alias("document"), "text",
    ).write.format("fragments").mode("append").option("path", path).save()


def _bytes(system: fs.FileSystem, names: list[str]) -> Iterator[bytes]:
    for name in names:
        with system.open_input_stream(name) as file:
            while data := file.read(1 << 20):
                yield bytes(data)


def read(path: str, documents: list[str]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """The given documents of the last whole run, each as a stream of bytes."""
    system, root = _system(path)
    with system.open_input_stream(f"{root}/{LIST}") as file:
        told = json.loads(file.read())
    for document in documents:
        listed = system.get_file_info(fs.FileSelector(f"{root}/{_folder(document)}", allow_not_found=True))
        names = sorted(i.base_name for i in listed)
        good = [n for n in names if n.split("-")[0] == told["run"]
                and told["attempts"].get(str(int(n.split("-")[1]))) == n.split("-")[2]]
        yield document, _bytes(system, [f"{root}/{_folder(document)}/{n}" for n in good])


def _pieces(df: DataFrame, piece: int, text: Column, pos: Column | None = None, part: int = 0) -> DataFrame:
    return df.select("case_id", F.lit(2).alias("section"), "row_sort", F.lit(part).alias("part"),
                     F.lit(piece).alias("piece"), (F.lit(0) if pos is None else pos).cast("long").alias("pos"),
                     text.alias("text"))


def _with_first(rows: DataFrame, children: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their children, and children with their row and whether they are
    its first."""
    facts = children.groupBy("row_id").agg(
        F.count(F.lit(1)).alias(f"_n_{name}"), F.min("pos").alias("_first"))
    marked = children.join(facts.select("row_id", "_first"), "row_id").join(
        rows.select("row_id", "case_id", "row_sort"), "row_id").withColumn("first", F.col("pos") == F.col("_first"))
    return rows.join(facts.drop("_first"), "row_id", "left").fillna(0, [f"_n_{name}"]), marked


def json_fragments(rows: DataFrame, locators: DataFrame, bullets: DataFrame) -> DataFrame:
    """The objects of ``export.json_rows``, one per line, byte for byte, as fragments."""
    keyed = rows.withColumn("row_sort", F.struct("row_id"))
    keyed, places = _with_first(keyed, locators.drop("case_id"), "locators")
    keyed, lines = _with_first(keyed, bullets, "bullets")
    head = F.to_json(F.struct(*export.row_object()))

    def element(name: str, *columns) -> Column:
        opening = F.when(F.col("first"), F.lit(f',"{name}":[')).otherwise(F.lit(","))
        return F.concat(opening, F.to_json(F.struct(*columns)))

    def close(name: str) -> Column:
        return F.when(F.col(f"_n_{name}") > 0, F.lit("]")).otherwise(F.lit(""))

    out = _pieces(keyed, 0, F.substring(head, F.lit(1), F.length(head) - 1))
    for more in (
        _pieces(places, 1, element("locators", *export.locator_object()), F.col("pos")),
        _pieces(keyed, 2, close("locators")),
        _pieces(lines, 3, element("bullets", *export.bullet_object()), F.col("pos")),
        _pieces(keyed, 4, F.concat(close("bullets"), F.lit("}\n"))),
    ):
        out = out.unionByName(more)
    return out.where("text <> ''")


def markdown_fragments(rows: DataFrame, locators: DataFrame, bullets: DataFrame, pack: Pack) -> DataFrame:
    """The lines of ``export.markdown_lines``, byte for byte, as fragments."""
    shown = rows.where(F.col("excluded_by").isNull()).withColumn("row_sort", export.row_sort())
    _, places = _with_first(shown, locators.drop("case_id"), "locators")
    _, lines = _with_first(shown, bullets, "bullets")
    opening = F.concat_ws("<br>", F.concat(F.lit("**"), F.col("title_cell"), F.lit("**")), "illegible_cell")
    place = F.regexp_replace("locator", "\n", "<br>")
    table = _pieces(shown, 0, F.concat(F.lit("| "), F.col("date_cell"), F.lit(" | ")))
    for more in (
        _pieces(places, 1, F.concat(F.when(F.col("first"), "").otherwise(" ; "), place), F.col("pos")),
        _pieces(shown, 2, F.concat(F.lit(" | "), opening)),
        _pieces(lines, 3, F.concat(F.lit("<br>• "), F.col("text")), F.col("pos")),
        _pieces(shown, 4, F.concat(F.coalesce(F.concat(F.lit("<br>"), F.col("warning_cell")), F.lit("")), F.lit(" |\n"))),
    ):
        table = table.unionByName(more)
    others = export.markdown_frame(rows, pack).select(
        "case_id", "section", "row_sort", "part", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("pos"),
        F.concat("line", F.lit("\n")).alias("text"))
    return table.unionByName(others)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """(document, n_bytes, sha256) of written documents (document), read as streams in tasks."""
    def told(batches):
        for batch in batches:
            names, sizes, sums = [], [], []
            for document, parts in read(path, batch.column("document").to_pylist()):
                made, size = hashlib.sha256(), 0
                for data in parts:
                    made.update(data)
                    size += len(data)
                names.append(document)
                sizes.append(size)
                sums.append(made.hexdigest())
            yield pa.RecordBatch.from_pydict({
                "document": pa.array(names, pa.string()), "n_bytes": pa.array(sizes, pa.int64()),
                "sha256": pa.array(sums, pa.string())})

    return documents.select("document").mapInArrow(told, "document string, n_bytes long, sha256 string")
