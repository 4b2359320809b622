"""Attachment files, archive contracts, packages and paged sources."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from ..operators.dom import plain_text
from ..operators.html import decode, table_markdown
from .tables import EACH, MEMBERS, RATIO, TOTAL

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _bounded(z: zipfile.ZipFile) -> None:
    """Raises ValueError for an archive beyond the budgets of zip_members."""
    infos = z.infolist()
    if len(infos) > 10 * MEMBERS or sum(i.file_size for i in infos) > TOTAL or any(i.file_size > EACH or i.file_size > RATIO * max(1, i.compress_size) for i in infos):
        raise ValueError("archive_budget")


def docx_text(content: bytes) -> str:
    """Paragraphs and tables of a Word file in their order, as Markdown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        _bounded(z)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            out.append(words(node))
        elif node.tag == f"{_W}tbl":
            out.append(table_markdown([[words(c) for c in row.iter(f"{_W}tc")] for row in node.iter(f"{_W}tr")]))
    return "\n\n".join(x for x in out if x)


def xlsx_text(content: bytes) -> str:
    """Each sheet as a Markdown table under its name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        _bounded(z)
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in tree.iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_S}c"):
                    letters = re.match("[A-Z]*", c.get("r") or "")[0]
                    at = len(cells)
                    if letters:
                        at = 0
                        for ch in letters:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if v is None else v.text or ""
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                if cells:
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            out.append(f"## {sheet.get('name')}\n\n{table_markdown(rows)}")
    return "\n\n".join(out)


def file_text(path: str, content: bytes) -> tuple[str, str]:
    """Text of a file by its suffix, and a flag: '' or why there is none."""
    suffix = path.lower().rpartition(".")[2]
    try:
        if suffix in ("txt", "md"):
            return decode(content)[0], ""
        if suffix == "csv":
            return table_markdown(list(csv.reader(io.StringIO(decode(content)[0])))), ""
        if suffix in ("html", "htm"):
            return plain_text(decode(content)[0]), ""
        if suffix == "docx":
            return docx_text(content), ""
        if suffix == "xlsx":
            return xlsx_text(content), ""
    except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError):
        return "", "parse_failure"
    return "", "unsupported_or_image"


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, content (the binaryFile source). path, text, flag."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            got = [file_text(p.as_py(), c.as_py() or b"") for p, c in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["path", "text", "flag"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, flag string")


#: Names of the breaches of the archive contract, in the order in which one
#: member is tested for them.
BREACHES = ["unsafe_archive_member", "duplicate_archive_member", "encrypted_archive_member"]


def archive_listing(files: DataFrame) -> DataFrame:
    """path, sha256 and members (name, size, encrypted) of each archive; null members for what
    is none."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("size", pa.int64()), ("encrypted", pa.bool_())]))

    def listed(content: bytes) -> list[dict] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return [{"name": i.filename, "size": i.file_size, "encrypted": bool(i.flag_bits & 1)} for i in z.infolist()]
        except zipfile.BadZipFile:
            return None

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            content = [c.as_py() or b"" for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(c).hexdigest() for c in content], pa.string()), pa.array([listed(c) for c in content], kind)], names=["path", "sha256", "members"])

    return files.select("path", "content").mapInArrow(run, "path string, sha256 string, members array<struct<name:string,size:long,encrypted:boolean>>")


def archive_contract(files: DataFrame, members: int = 50, total: int = 50 << 20) -> DataFrame:
    """path, members, bytes, sha256, fault of each archive. The rules stand as a table of tests
    on a member; the first member that fails one names the fault, then the budget counts."""
    m = F.col("_members")
    names = F.transform(m, lambda x: x["name"])
    tests = {
        "unsafe_archive_member": lambda x, i: F.translate(x["name"], "\\", "/").rlike(r"^/|(^|/)\.\.(/|$)|^[A-Za-z]:"),
        "duplicate_archive_member": lambda x, i: F.array_position(names, x["name"]) <= i,
        "encrypted_archive_member": lambda x, i: x["encrypted"],
    }

    def breach(x: Column, i: Column) -> Column:
        return F.coalesce(*[F.when(tests[n](x, i), F.concat(F.lit(f"{n}:"), x["name"])) for n in BREACHES])

    size = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    first = F.try_element_at(F.array_compact(F.transform(m, breach)), F.lit(1))
    over = F.when((F.size(m) > members) | (size > total), "archive_budget_exceeded")
    fault = F.when(m.isNull(), "not_an_archive").otherwise(F.coalesce(first, over, F.lit("")))
    # the list has another name than the count, which would hide it
    return archive_listing(files).withColumnRenamed("members", "_members").select("path", F.coalesce(F.size(m), F.lit(0)).cast("long").alias("members"), F.coalesce(size, F.lit(0)).alias("bytes"), "sha256", fault.alias("fault"))


def jsonl_member(content: bytes, suffix: str) -> list[dict]:
    """Rows of the one member whose name ends so."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.endswith(suffix)]
        if len(names) != 1:
            raise ValueError(f"expected_one_archive_member:{suffix}:{len(names)}")
        return [json.loads(line) for line in z.read(names[0]).decode("utf-8-sig").splitlines() if line.strip()]


def package(folder: str, out: str) -> dict[str, str]:
    """Zips a folder with a manifest of digests and reads it back to verify."""
    names = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)
    digests = {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            with open(os.path.join(folder, name), "rb") as f:
                data = f.read()
            digests[name] = hashlib.sha256(data).hexdigest()
            z.writestr(name, data)
        z.writestr("MANIFEST.json", json.dumps(digests, indent=2, sort_keys=True))
    if verify_package(out):
        raise ValueError("package_not_verified")
    return digests


def verify_package(path: str) -> list[str]:
    """Names whose bytes don't fit the manifest, or that only one side has."""
    with zipfile.ZipFile(path) as z:
        want = json.loads(z.read("MANIFEST.json"))
        have = set(z.namelist()) - {"MANIFEST.json"}
        wrong = [n for n in have & set(want) if hashlib.sha256(z.read(n)).hexdigest() != want[n]]
        return sorted(wrong + list(have ^ set(want)))


class _Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.value = number


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.url, self.rows, self.limit = options["url"], int(options.get("pagesize", 100)), int(options.get("limit", 0))

    def _get(self, page: int) -> dict:
        from urllib.request import urlopen

        with urlopen(self.url.replace("{page}", str(page)), timeout=30) as f:
            return json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        total = int(self._get(1)["total"])
        if self.limit:
            total = min(total, self.limit)
        return [_Page(i + 1) for i in range(max(1, -(-total // self.rows)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        done = (partition.value - 1) * self.rows
        for i, row in enumerate(self._get(partition.value)["items"]):
            if self.limit and done + i >= self.limit:
                return
            yield (str(row.get("id", "")), json.dumps(row, sort_keys=True))


class PagedJson(DataSource):
    """spark.read.format("paged_json"): pages of a REST listing, {"total", "items"}, one
    partition each. Options: url with {page}, pageSize, limit."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "id string, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _Query(InputPartition):
    def __init__(self, query: str) -> None:
        self.value = query


class _SearchReader(DataSourceReader):
    """Asks only for the queries that the filter names, and for no more rows than the bound."""

    def __init__(self, options: dict) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.url, self.limit = o["url"], int(o.get("limit", 0))
        self.items, self.domains = o.get("items", "results").split("."), [d.strip().lower() for d in o.get("domains", "").split(",") if d.strip()]
        self.fields = dict(x.split("=") for x in o.get("fields", "title=title,url=url,snippet=content,published=publishedDate").split(","))
        self.most, self.queries = int(o.get("maxbytes", 2 << 20)), None

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is None or f.attribute != ("query",):
                yield f
            else:
                self.queries = asked if self.queries is None else self.queries & asked

    def partitions(self) -> list[InputPartition]:
        if self.queries is None:
            raise ValueError("a search needs a filter on query: equal to a text or one of several")
        return [_Query(q) for q in sorted(q for q in self.queries if q and q.strip())] or [_Query("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.parse import quote
        from urllib.request import urlopen

        if not partition.value:
            return
        wide = [d for d in self.domains if not any(d != x and d.endswith("." + x) for x in self.domains)]
        scoped = f"{partition.value.strip()} {' OR '.join('site:' + d for d in dict.fromkeys(wide))}".strip()
        with urlopen(self.url.replace("{query}", quote(scoped)).replace("{limit}", str(self.limit or "")), timeout=30) as f:
            found = json.loads(f.read(self.most))
        for name in self.items:
            found = (found or {}).get(name) or []
        for rank, row in enumerate(found[: self.limit or None], 1):
            yield (partition.value, rank, *[None if row.get(v) is None else str(row[v]) for v in self.fields.values()])


class SearchResults(DataSource):
    """spark.read.format("search_results").load().where("query IN (...)"): results of a search
    provider, one request for each query that the filter names (it must name some). Options:
    url with {query} and {limit}; limit, the bound on rows of a query, which the provider is
    told and which holds even if it sends more; domains, to which queries are scoped; items,
    the path of the list in the answer; fields, column=name pairs; maxBytes of an answer.
    Needs spark.sql.python.filterPushdown.enabled. An answer that fails fails the read. Load
    anew for each filter: Spark keeps what it has pushed into a loaded source."""

    @classmethod
    def name(cls) -> str:
        return "search_results"

    def schema(self) -> str:
        fields = {k.lower(): v for k, v in self.options.items()}.get("fields", "title=,url=,snippet=,published=")
        return "query string, rank int, " + ", ".join(f"{x.split('=')[0]} string" for x in fields.split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
    spark.dataSource.register(SearchResults)
