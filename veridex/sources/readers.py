"""Sources and sinks with explicit schemas."""

from __future__ import annotations

import json
import tempfile
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veridex.schemas import CALL_LOG, PATIENT, RETRIEVAL, STUDY, TRIAL

#: Statuses by which the source filters.
STATUSES = ("RECRUITING", "ACTIVE_NOT_RECRUITING", "COMPLETED", "NOT_YET_RECRUITING", "TERMINATED")

#: The profile that ``patients`` gives for the name ``example``.
EXAMPLE = {
    "patient_id": "TCGA-05-4418-derived", "diagnosis": "Lung adenocarcinoma", "stage": "IV", "age_years": 63, "sex": "MALE", "ecog": 1, "smoking_status": "former", "histology": "adenocarcinoma",
    "brain_metastases": False, "prior_malignancy": None, "tmb": 4.6, "pd_l1_tps": 15.0, "msi_status": "MSS",
    "mutations": [
        ("KRAS", "p.G12C", "Missense_Mutation", 0.41, True, 5), ("STK11", "p.G56V", "Missense_Mutation", 0.39, False, 3),
        ("KEAP1", "p.F280Y", "Missense_Mutation", 0.43, False, 3), ("RBM10", "p.G17Wfs*4", "Frame_Shift_Ins", 0.42, False, 4),
    ],
    "treatment_history": [(1, "carboplatin + pemetrexed + pembrolizumab", "2025-11-10", "2026-06-20", "PD", "progression")],
}


def studies(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of raw studies, one row each."""
    return spark.read.schema(STUDY).option("multiLine", True).json(path)


def trials(spark: SparkSession, path: str) -> DataFrame:
    """Parsed trials: a JSON array, or an envelope with ``candidates``."""
    envelope = spark.read.schema(f"candidates ARRAY<STRUCT<{_nested(TRIAL)}, {_nested(RETRIEVAL)}>>").option("multiLine", True).json(path)
    inside = envelope.filter(F.col("candidates").isNotNull()).selectExpr("inline(candidates)")
    if not inside.isEmpty():
        return inside
    return spark.read.schema(f"{TRIAL}, {RETRIEVAL}").option("multiLine", True).json(path)


def _nested(ddl: str) -> str:
    """Column DDL as the fields of a struct."""
    depth, out, named = 0, [], False
    for c in " ".join(ddl.split()):
        depth += (c == "<") - (c == ">")
        if depth == 0 and c == " " and not named and out and out[-1] not in ", ":
            out.append(": ")
            named = True
            continue
        if depth == 0 and c == ",":
            named = False
        out.append(c)
    return "".join(out)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that Spark can list; earlier ones take precedence."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def patients(spark: SparkSession, path: str) -> DataFrame:
    """Profiles; an unknown key or a broken row is an error. ``example`` is a built-in profile."""
    if path == "example":
        return spark.createDataFrame([EXAMPLE], PATIENT)
    found = spark.read.schema(PATIENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return found.withColumns({c: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType)) for c in ("mutations", "treatment_history")})


def call_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL_LOG).json(path)


def successful_local_calls(log: DataFrame) -> DataFrame:
    return log.filter((F.col("backend") == "local") & (F.coalesce(F.col("error"), F.lit("")) == ""))


def append_log(rows: DataFrame, path: str, batch: str) -> None:
    """Adds a batch's rows to a log of JSON lines, in a partition of its own; a batch that comes again replaces itself."""
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def log_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's present rows to a log, each once: what a failure makes Spark do again has the same batch."""
    return rows.writeStream.foreachBatch(lambda some, k: append_log(some, path, str(k))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_json(rows: DataFrame, path: str, most_in_file: int = 0) -> None:
    """Null fields are kept; the committer replaces the target as a whole. ``most_in_file`` rows go into a file (0: any number);
    files that are to be read as one object each, such as envelopes, have one."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).option("maxRecordsPerFile", most_in_file).json(path)


def http_get(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
        return json.load(answer)


def _page(url: str, condition: str, status: str, fields: Sequence[str], size: int, token: str | None, get: Callable[[str], dict]) -> dict:
    asked = {"query.cond": condition, "pageSize": size, "fields": ",".join(fields), "filter.overallStatus": status} | ({"pageToken": token} if token else {})
    return get(f"{url}?{urllib.parse.urlencode(asked)}")


def _status(name: str) -> str:
    if name not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    return name


def study_pages(url: str, condition: str, status: str, fields: Sequence[str], limit: int, get: Callable[[str], dict] = http_get, pause: float = 0.3) -> Iterator[dict]:
    """Raw studies page by page until a page is empty, has no token, or the limit is reached."""
    _status(status)
    token, seen = None, 0
    while seen < limit:
        page = _page(url, condition, status, fields, min(100, limit - seen), token, get)
        found = page.get("studies", [])
        yield from found[: limit - seen]
        seen, token = seen + len(found), page.get("nextPageToken")
        if not found or not token:
            return
        time.sleep(pause)


#: What the source calls the fields of the columns, and where a raw study has them.
STUDY_COLUMNS = {
    "nct_id": ("NCTId", ("identificationModule", "nctId")), "title": ("BriefTitle", ("identificationModule", "briefTitle")), "official_title": ("OfficialTitle", ("identificationModule", "officialTitle")),
    "status": ("OverallStatus", ("statusModule", "overallStatus")), "study_type": ("StudyType", ("designModule", "studyType")), "sex": ("Sex", ("eligibilityModule", "sex")), "criteria": ("EligibilityCriteria", ("eligibilityModule", "eligibilityCriteria")),
}


class StudySource(DataSource):
    """``spark.read`` and ``spark.readStream.format("studies")`` over a paged HTTP source.

    Columns: ``study`` (the raw study as JSON, with the fields of the option ``fields`` or all) and those of ``STUDY_COLUMNS``;
    a schema of some of them makes the source send no other fields. Options: ``url, condition, status, fields, pause``, and
    for batches ``limit`` and ``pushdown`` (``true``: a filter of the status is the source's own; the session needs
    ``spark.sql.python.filterPushdown.enabled`` for that)."""

    @classmethod
    def name(cls) -> str:
        return "studies"

    def schema(self) -> str:
        return "study string, nct_id string, status string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_PushedReader if self.options.get("pushdown") == "true" else _StudyReader)(_Asked(self.options, schema.names))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StudyStream(_Asked(self.options, schema.names))


class _Asked:
    """What a reader asks the source for."""

    def __init__(self, options: dict, columns: Sequence[str]):
        if unknown := set(columns) - {"study", *STUDY_COLUMNS}:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.columns, self.url, self.condition = list(columns), options["url"], options.get("condition", "")
        self.status = _status(options.get("status", "RECRUITING"))
        self.limit, self.pause = int(options.get("limit", "100")), float(options.get("pause", "0.3"))
        self.fields = [f for f in options.get("fields", "").split(",") if f]
        if "study" not in columns or self.fields:
            self.fields = list(dict.fromkeys([*self.fields, *(STUDY_COLUMNS[c][0] for c in columns if c != "study")]))

    def row(self, study: dict) -> tuple:
        return tuple(json.dumps(study, ensure_ascii=False) if c == "study" else self._value(study, STUDY_COLUMNS[c][1]) for c in self.columns)

    @staticmethod
    def _value(study: dict, path: tuple[str, str]) -> str | None:
        return study.get("protocolSection", {}).get(path[0], {}).get(path[1])

    def page(self, token: str | None, fields: Sequence[str] | None = None) -> dict:
        return _page(self.url, self.condition, self.status, self.fields if fields is None else fields, 100, token, http_get)


class _StudyReader(DataSourceReader):
    """One partition, since each page names the next."""

    def __init__(self, asked: _Asked):
        self.asked, self.nothing = asked, False

    def partitions(self) -> Sequence[InputPartition]:
        return [] if self.nothing else [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a = self.asked
        yield from map(a.row, study_pages(a.url, a.condition, a.status, a.fields, a.limit, pause=a.pause))


class _PushedReader(_StudyReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        wanted = None
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("status",) and f.value in STATUSES:
                self.nothing |= wanted not in (None, f.value)
                self.asked.status = wanted = f.value
            else:
                yield f


class _Page(InputPartition):
    def __init__(self, token: str, begin: int, end: int | None):
        self.token, self.begin, self.end = token, begin, end


class _StudyStream(DataSourceStreamReader):
    """Pages as they come to be. An offset is a page's number and token, and how many of its studies are taken; the driver
    follows the tokens alone (it asks for ids), and each page is a task's. A page that has grown since goes on from there."""

    def __init__(self, asked: _Asked):
        self.asked, self.at = asked, self.initialOffset()

    def initialOffset(self) -> dict:
        return {"page": 0, "token": "", "taken": 0}

    def _after(self, at: dict) -> tuple[dict, int]:
        """The next page's offset, or the end of this one; and the number of this page's studies."""
        found = self.asked.page(at["token"], [STUDY_COLUMNS["nct_id"][0]])
        n, token = len(found.get("studies", [])), found.get("nextPageToken")
        return ({"page": at["page"] + 1, "token": token, "taken": 0} if token and n else at | {"taken": max(n, at["taken"])}), n

    def latestOffset(self) -> dict:
        while True:
            at = self.at
            self.at, _ = self._after(at)
            if self.at["page"] == at["page"]:
                return self.at
            time.sleep(self.asked.pause)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        pages, at = [], start
        while at["page"] < end["page"]:
            following, n = self._after(at)
            pages.append(_Page(at["token"], at["taken"], n))
            if following["page"] == at["page"]:
                raise ValueError(f"page {at['page']} of the source was followed by others before")
            at = following
        pages.append(_Page(at["token"], at["taken"], end["taken"]))
        self.at = max(self.at, end, key=lambda o: (o["page"], o["taken"]))
        return [p for p in pages if p.begin < p.end]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from map(self.asked.row, self.asked.page(partition.token).get("studies", [])[partition.begin : partition.end])


def to_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON text; null fields are kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


#: Rows of an envelope, which is one row itself.
MOST_IN_ENVELOPE = 10_000


def envelope(rows: DataFrame, name: str, **header: str) -> DataFrame:
    """One row: the header's fields and all rows as an array under ``name``. Refuses more than ``MOST_IN_ENVELOPE``: such
    tables are written as they are, beside a table of one row for the header."""
    if rows.limit(MOST_IN_ENVELOPE + 1).count() > MOST_IN_ENVELOPE:
        raise ValueError(f"more than {MOST_IN_ENVELOPE} rows don't go into one envelope")
    collected = rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))
    return collected.select(*(F.lit(v).alias(k) for k, v in header.items()), name)


_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; on one machine that has none, one temporary
    folder for the whole session."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="veridex-")
    return _own_root


def scratch(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to a folder of its own below ``shared_root`` and read back, where it is used several times; in a
    partition for each value of the columns ``by``, if parts of it are read alone."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/veridex-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what ``scratch`` has written for this application, once no table made of it is read any more."""
    of = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/veridex-{spark.sparkContext.applicationId}")
    of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)


def exists(spark: SparkSession, path: str) -> bool:
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark._jsc.hadoopConfiguration()).exists(of)
