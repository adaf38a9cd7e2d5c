"""File sources and sinks: JSON lines, CSV, XLSX, nested segment documents, reports, logs, models."""
from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): every line with its 1-based number in its file.

    Lines are counted split by split, and a split's first line follows the counts of the file's earlier
    splits, so that a file of any size is numbered without one task reading it."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    x = t.withColumn("k", F.row_number().over(Window.partitionBy("path", "split").orderBy("id")))
    n = t.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(F.col("path").alias("np"), F.col("split").alias("ns"), before.alias("before"))
    x = x.join(n, (F.col("path") == F.col("np")) & (F.col("split") == F.col("ns")))
    return x.select("path", (F.col("before") + F.col("k")).alias("line_no"), "line")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str, numbered: bool = False) -> DataFrame:
    """One row per non-blank line: path, line, obj (struct or null) and error ('invalid_json', 'not_an_object', null); line_no if ``numbered``.

    A bad line never fails the load.  Numbering costs a shuffle of the lines."""
    t = numbered_lines(spark, path) if numbered else spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    t = t.filter(F.trim("line") != "")
    v = F.try_parse_json("line")
    kind = F.schema_of_variant(v)
    err = F.when(v.isNull(), "invalid_json").when(~F.startswith(kind, F.lit("OBJECT")), "not_an_object")
    return t.withColumn("error", err).withColumn("obj", F.when(F.col("error").isNull(), F.from_json("line", schema)))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of all lines; a bad line raises an error that names its file and number."""
    x = read_jsonl_lenient(spark, path, schema)
    if x.filter("error is not null").limit(1).count():
        bad = read_jsonl_lenient(spark, path, schema, numbered=True).filter("error is not null")
        r = bad.agg(F.min(F.struct("path", "line_no", "error")).alias("r")).first()["r"]
        raise ValueError(f"{r['path']}, line {r['line_no']}: {r['error']}")
    return x.select("obj.*")


def read_sessions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Events of <root>/ses_*/chunk_*/events.jsonl with session_dir and chunk_dir from the path.

    Where the schema has correlation, chunk_id is the one it states, else the folder's name, and sequence_number
    is 0 where missing.  Bad lines are left to ``bad_lines``; ``event_order`` gives the total order."""
    e = read_jsonl_lenient(spark, f"{root}/ses_*/chunk_*/events.jsonl", schema).filter("error is null")
    part = lambda p: F.regexp_extract("path", rf"/({p}_[^/]*)/", 1)
    e = e.select(part("ses").alias("session_dir"), part("chunk").alias("chunk_dir"), "obj.*")
    if "correlation" not in e.columns:
        return e
    held = set(e.schema["correlation"].dataType.names)
    if "chunk_id" in held:
        e = e.withColumn("chunk_id", F.coalesce(F.nullif("correlation.chunk_id", F.lit("")), "chunk_dir"))
    return e.withColumn("sequence_number", F.coalesce("correlation.sequence_number", F.lit(0))) if "sequence_number" in held else e


def event_order(events: DataFrame) -> list[str]:
    """Columns of the total order of events that the table has: time, sequence number, id."""
    return [c for c in ("timestamp_ms", "sequence_number", "event_id") if c in events.columns]


def bad_lines(spark: SparkSession, root: str) -> DataFrame:
    """(session_dir, error, n): the lines of a session that are no JSON objects."""
    x = read_jsonl_lenient(spark, f"{root}/ses_*/chunk_*/events.jsonl", "event_id string").filter("error is not null")
    return x.groupBy(F.regexp_extract("path", "/(ses_[^/]*)/", 1).alias("session_dir"), "error").agg(F.count("*").alias("n"))


def first_events(events: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n valid rows in a stated order."""
    return events.orderBy(*order).limit(n)


# fixed values: keys that hold segments
WRAPPERS = ("segments", "predictions", "ground_truth", "data", "records", "sessions")


def find_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments (session_id, start, end, label) in JSON documents of unknown wrapping.

    Known wrappers and nested lists are opened in turn, as deep as they go; a document is one row's text.
    Unreadable documents have no segments; other values than texts are written as JSON."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b["value"]:
                try:
                    stack = [json.loads(text)]
                except (ValueError, RecursionError):
                    continue
                while stack:
                    v = stack.pop()
                    if isinstance(v, list):
                        stack += reversed(v)
                    elif isinstance(v, dict):
                        row = [x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in map(v.get, ("session_id", "start", "end", "label"))]
                        if None not in row[:3]:
                            rows.append(row)
                        stack += [v[w] for w in reversed(WRAPPERS) if w in v]
            yield pd.DataFrame(rows, columns=["session_id", "start", "end", "label"])

    return spark.read.option("wholetext", True).text(path).mapInPandas(run, "session_id string, start string, `end` string, label string")


def read_ground_truth(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """sessions[].segments[] of ground-truth documents; owner = execution_id, else segment_id; wrong versions fail."""
    schema = "version string, sessions array<struct<session_id:string,segments:array<struct<segment_id:string,execution_id:string,process_code:string,start:string,`end`:string>>>>"
    g = spark.read.schema(schema).option("multiLine", True).json(path)
    if version is not None and g.filter(~F.col("version").eqNullSafe(F.lit(version))).limit(1).count():
        raise ValueError(f"a ground-truth file is not of version {version}")
    x = g.select(F.explode("sessions").alias("s")).select(F.col("s.session_id").alias("session_id"), F.explode("s.segments").alias("g")).select("session_id", "g.*")
    return x.withColumn("owner", F.coalesce(F.nullif("execution_id", F.lit("")), "segment_id"))


def _slug(name: str) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", name.lstrip("\ufeff").lower()))


def read_csv(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """CSV with header: BOM removed, names as slugs, all text; ``numbered`` adds file_row, the record's number in its file (the header is 1).

    Records may hold line breaks, so a file is read by one task anyway, and numbered by one."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = df.toDF(*[_slug(c) for c in df.columns])
    if not numbered:
        return out
    out = out.withColumns({"__p": F.input_file_name(), "__i": F.monotonically_increasing_id()})
    return out.withColumn("file_row", F.row_number().over(Window.partitionBy("__p").orderBy("__i")) + 1).drop("__p", "__i")


_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of an OOXML workbook, by the standard library alone."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rel = f"{{{_REL}}}id"
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                t = r.get("Target", "")
                targets[r.get("Id")] = t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        for no, sheet in enumerate(book.iterfind("m:sheets/m:sheet", _NS), 1):  # a sheet's part is named by its relationship
            title, f = sheet.get("name"), targets.get(sheet.get(rel), f"xl/worksheets/sheet{no}.xml")
            if f not in names:
                continue
            for row in ElementTree.fromstring(z.read(f)).iterfind("m:sheetData/m:row", _NS):
                cells: dict[int, str] = {}
                for c in row.iterfind("m:c", _NS):
                    col = 0
                    for ch in re.match(r"[A-Z]+", c.get("r", "A")).group():
                        col = col * 26 + ord(ch) - 64
                    v = c.findtext("m:v", None, _NS)
                    if c.get("t") == "s" and v is not None:
                        v = shared[int(v)]
                    elif c.get("t") == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    cells[col] = v or ""
                yield title, int(row.get("r", 0)), [cells.get(i, "") for i in range(1, max(cells, default=0) + 1)]


def find_header(rows: list[list[str]], wanted: list[str], least: int, within: int = 20) -> int | None:
    """Index of the row, of the first ``within``, that shares most names with ``wanted`` (at least ``least``)."""
    score = [len({_slug(c) for c in r} & set(wanted)) for r in rows[:within]]
    best = max(range(len(score)), key=lambda i: (score[i], -i), default=None)
    return best if best is not None and score[best] >= least else None


class XlsxSource(DataSource):
    """spark.read.format('xlsx').option('path', file).option('columns', 'a,b,c').option('least', 2): rows of every sheet that has a header.

    Sheets without a recognisable header are skipped.  Columns: sheet, row, then the wanted columns as text."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "sheet string, row int, " + ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self.options)


class _XlsxReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths, self.columns = options["path"].split(","), options["columns"].split(",")
        self.least = int(options.get("least", len(self.columns)))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            data = f.read()
        yield from workbook_records(data, self.columns, self.least)


def workbook_records(data: bytes, columns: list[str], least: int) -> Iterator[tuple]:
    """(sheet, row, wanted columns ...) of every sheet with a header."""
    sheets: dict[str, list] = {}
    for title, n, cells in sheet_rows(data):
        sheets.setdefault(title, []).append((n, cells))
    for title, rows in sheets.items():
        h = find_header([c for _, c in rows], columns, least)
        if h is None:
            continue
        at = {_slug(c): i for i, c in enumerate(rows[h][1])}
        for n, cells in rows[h + 1 :]:
            if any(c.strip() for c in cells):
                yield (title, n, *[cells[at[c]] if c in at and at[c] < len(cells) else None for c in columns])


def read_xlsx(spark: SparkSession, path: str, columns: list[str], least: int = 1) -> DataFrame:
    """(path, sheet, row, wanted columns as text) of workbooks on any storage Spark reads; a workbook is one task's."""
    schema = "path string, sheet string, row int, " + ", ".join(f"`{c}` string" for c in columns)

    def run(batches):
        for b in batches:
            rows = [(p, *r) for p, data in zip(b["path"], b["content"]) for r in workbook_records(bytes(data), columns, least)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines, UTF-8 as it is; ``single`` where one file is asked for (small results only)."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """One file of JSON lines in a stated order; for results one task can sort."""
    df.repartition(1).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report(df: DataFrame) -> str:
    """A one-row aggregate as a JSON object."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is made of exactly one row")
    return rows[0][0]


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A summary of at most ``limit`` rows as a Markdown table; more rows are an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write them as a table instead")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""])


def merge_latest(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Upsert: the row with the highest version of each key; of equal versions the one from ``new``."""
    x = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("__n"))
    return x.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__n")


def append_log(df: DataFrame, path: str) -> None:
    """Append-only log as Parquet."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    return spark.read.parquet(path).orderBy(*order)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
