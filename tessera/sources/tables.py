"""Table loading, JSON lines, archives, and views over the event and corpus tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables:
    """tables("orders") reads <dir>/orders.parquet; views are methods."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def run_events(self) -> DataFrame:
        """The append-only event log: a run is one user's day."""
        kind = F.when(F.col("event_type") == "view", "route.resolved").when(F.col("event_type") == "click", "message.delta").when(F.col("event_type") == "signup", "message.completed").when(F.col("event_type") == "purchase", "run.completed").otherwise("run.failed")
        run = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string"))
        return self("events").select(F.col("event_id").alias("sequence"), run.alias("run_id"), "user_id", F.col("ts").alias("created_at"), kind.alias("event_type"), F.col("props").alias("payload"), "value")

    def agent_runs(self) -> DataFrame:
        """One row per run; the first terminal event decides the status."""
        e = self.run_events()
        first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("sequence")))
        g = e.groupBy("run_id").agg(F.min("user_id").alias("user_id"), F.min("created_at").alias("created_at"), first("run.completed").alias("c"), first("run.failed").alias("f"))
        status = F.when(F.col("c").isNull() & F.col("f").isNull(), "QUEUED").when(F.col("f").isNull() | (F.col("c") < F.col("f")), "COMPLETED").otherwise("FAILED")
        return g.select("run_id", "user_id", "created_at", status.alias("status"), F.when(status == "FAILED", F.concat(F.lit("code_"), F.pmod(F.col("f"), F.lit(7)).cast("string"))).otherwise("").alias("error_code"))

    def users(self) -> DataFrame:
        return self("events").groupBy("user_id").agg(F.min("ts").alias("created_at"))

    def messages(self) -> DataFrame:
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id * 60 + turn as int), 0)")
        return self("conversations").select(F.concat(F.lit("m-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").alias("session_id"), F.pmod(F.col("conv_id"), F.lit(50)).alias("user_id"), "turn", "role", F.col("text").alias("content"), at.alias("created_at"))

    def kb_sources(self) -> DataFrame:
        return self("documents").select("source").distinct().select(F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/")).alias("official_url"), (F.col("source") != "src3").alias("active"), F.concat(F.lit("Office "), "source").alias("source_name"))

    def kb_documents(self) -> DataFrame:
        d, lab = self("documents"), self("labels")
        q, t = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
        return d.join(lab, "doc_id", "left").select("doc_id", F.col("source").alias("source_id"), F.when(q == 1, "ACCEPTED").otherwise("REVIEW").alias("review_status"), (t == 1).alias("pii_detected"), (F.coalesce(q, F.lit(0)) == 1).alias("rag_eligible"), "text", "lang", "n_chars")

    def kb_mappings(self) -> DataFrame:
        return self("documents").select(F.concat(F.lit("kb-"), F.col("doc_id").cast("string")).alias("knowledge_id"), "doc_id", F.when(F.pmod("doc_id", F.lit(5)) == 0, "PENDING").otherwise("IMPORTED").alias("import_status"), F.when(F.pmod("doc_id", F.lit(4)) == 1, F.concat(F.lit("att-"), F.col("doc_id").cast("string"))).alias("attachment_id"))

    def kb_attachments(self) -> DataFrame:
        """Every fourth document carries an attachment, every eighth of them two."""
        d = self.kb_documents().where(F.pmod("doc_id", F.lit(4)) == 1)
        n = F.when(F.pmod("doc_id", F.lit(8)) == 1, 2).otherwise(1)
        return d.withColumn("k", F.explode(F.sequence(F.lit(1), n))).select(F.concat(F.when(F.col("k") == 1, F.lit("att-")).otherwise(F.lit("more-")), F.col("doc_id").cast("string")).alias("attachment_id"), "doc_id", F.concat(F.lit("file-"), F.col("k").cast("string"), F.lit(".pdf")).alias("name"), F.concat(F.lit("https://"), "source_id", F.lit(".example.org/f/"), F.col("doc_id").cast("string")).alias("url"), (F.pmod("doc_id", F.lit(12)) != 1).alias("rag_eligible"), F.col("pii_detected"), "review_status", F.col("k").alias("ord"))

    def relations(self) -> DataFrame:
        return self("documents").where(F.pmod("doc_id", F.lit(4)) == 1).select(F.col("doc_id").alias("child_id"), F.floor(F.col("doc_id") / 10).cast("long").alias("parent_id"))


#: The same views as SQL, for the oracle: name -> query.
VIEWS = {
    "run_events": "SELECT event_id AS sequence, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, user_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'route.resolved' WHEN 'click' THEN 'message.delta' WHEN 'signup' THEN 'message.completed' WHEN 'purchase' THEN 'run.completed' ELSE 'run.failed' END AS event_type, props AS payload, value FROM events",
    "agent_runs": "SELECT run_id, user_id, created_at, status, CASE WHEN status = 'FAILED' THEN 'code_' || CAST(f % 7 AS VARCHAR) ELSE '' END AS error_code FROM (SELECT *, CASE WHEN c IS NULL AND f IS NULL THEN 'QUEUED' WHEN f IS NULL OR c < f THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM (SELECT run_id, min(user_id) AS user_id, min(created_at) AS created_at, min(sequence) FILTER (WHERE event_type = 'run.completed') AS c, min(sequence) FILTER (WHERE event_type = 'run.failed') AS f FROM run_events GROUP BY 1))",
    "users": "SELECT user_id, min(ts) AS created_at FROM events GROUP BY 1",
    "messages": "SELECT 'm-' || conv_id || '-' || turn AS message_id, conv_id AS session_id, conv_id % 50 AS user_id, turn, role, text AS content, TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL '1' MINUTE AS created_at FROM conversations",
    "kb_sources": "SELECT DISTINCT source AS source_id, 'https://' || source || '.example.org/' AS official_url, source <> 'src3' AS active, 'Office ' || source AS source_name FROM documents",
    "kb_documents": "SELECT d.doc_id, d.source AS source_id, CASE WHEN l.quality = 1 THEN 'ACCEPTED' ELSE 'REVIEW' END AS review_status, coalesce(l.toxic, 0) = 1 AS pii_detected, coalesce(l.quality, 0) = 1 AS rag_eligible, d.text, d.lang, d.n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "kb_mappings": "SELECT 'kb-' || doc_id AS knowledge_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'PENDING' ELSE 'IMPORTED' END AS import_status, CASE WHEN doc_id % 4 = 1 THEN 'att-' || doc_id END AS attachment_id FROM documents",
    "kb_attachments": "SELECT CASE WHEN k = 1 THEN 'att-' ELSE 'more-' END || doc_id AS attachment_id, doc_id, 'file-' || k || '.pdf' AS name, 'https://' || source_id || '.example.org/f/' || doc_id AS url, doc_id % 12 <> 1 AS rag_eligible, pii_detected, review_status, k AS ord FROM (SELECT *, unnest(CASE WHEN doc_id % 8 = 1 THEN [1, 2] ELSE [1] END) AS k FROM kb_documents WHERE doc_id % 4 = 1)",
    "relations": "SELECT doc_id AS child_id, CAST(floor(doc_id / 10.0) AS BIGINT) AS parent_id FROM documents WHERE doc_id % 4 = 1",
}


def with_views(sql: str) -> str:
    """The statement behind WITH clauses for the views that it names."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if not head:
        return body
    if m := re.match(r"(?i)with(\s+recursive)?\s", body):
        return f"WITH{m[1] or ''} {head}, {body[m.end():]}"
    return f"WITH {head} {body}"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Only where that is unset and
    all runs on one machine, as in tests, a temporary folder takes its place; on a cluster
    each machine would have one of its own, so there it raises."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and not held.isDefined() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not path:
        path = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="tessera-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders that settle() writes within are removed at its end: write or collect the result
    before. Scopes may stand within each other; a folder goes with the innermost one. Without
    a scope what was settled stays, as a result may be read at any later time."""
    held: list[str] = []
    before = _SCOPES.set((*_SCOPES.get(), held))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        for path in held:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def kept_in_scope(path: str) -> str:
    """A folder of intermediate rows that the innermost scope removes."""
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    return path


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, what follows is
    computed from files that outlive any executor, and several readers share one computation.
    compression: a codec of Parquet in place of the session's. See scope() for its removal."""
    path = kept_in_scope(f"{checkpoint_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. A broken line fails the
    read; if not strict it gives a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def extends(old: T.StructType, new: T.StructType) -> list[str]:
    """What forbids reading old data with the new schema: dropped or retyped fields."""
    have = {f.name: f.dataType for f in new}
    return [f"dropped:{f.name}" if f.name not in have else f"retyped:{f.name}" for f in old if have.get(f.name) != f.dataType]


#: Limits of an archive scan.
MEMBERS, TOTAL, EACH, RATIO = 200, 60 << 20, 30 << 20, 250


def zip_members(files: DataFrame, members: int = MEMBERS, total: int = TOTAL, each: int = EACH, ratio: int = RATIO) -> DataFrame:
    """files: path, content (as the binaryFile source gives them). One row per member:
    path, member, size, data; an archive over a limit, or with an unsafe name, an
    encrypted or linked member, gives one row with the reason in `error`."""
    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            out: list[tuple] = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    out += [(path, *row, None) for row in _members(content.as_py(), members, total, each, ratio)]
                except (ValueError, zipfile.BadZipFile, RuntimeError) as error:
                    out.append((path, None, None, None, str(error) or "bad_zip"))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "member", "size", "data", "error"])

    return files.select("path", "content").mapInArrow(scan, "path string, member string, size long, data binary, error string")


def _members(content: bytes, members: int, total: int, each: int, ratio: int) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > members:
            raise ValueError("too_many_members")
        if sum(i.file_size for i in infos) > total:
            raise ValueError("archive_too_large")
        for i in infos:
            name = i.filename
            if not i.flag_bits & 0x800:
                try:
                    name = name.encode("cp437").decode("gbk")
                except UnicodeError:
                    pass
            if name.startswith("/") or ".." in name.replace("\\", "/").split("/"):
                raise ValueError("unsafe_path")
            if i.external_attr >> 28 == 0xA or i.flag_bits & 1:
                raise ValueError("link_or_encrypted")
            if i.file_size > each or i.file_size > ratio * max(1, i.compress_size):
                raise ValueError("member_too_large")
            yield name, i.file_size, z.read(i)
