"""Sources and sinks: corpora of files, question sets, transcripts, path lists, keyed tables."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skarn.functions.text import slug
from skarn.operators.catalog import in_corpus

#: What an ingested file may be.
SUFFIXES, MOST_BYTES = (".md", ".markdown", ".txt"), 2 * 1024 * 1024
PROVENANCE = ("real", "constructed", "negative")

GOLDEN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("expected_rel_paths", T.ArrayType(T.StringType())),
        T.StructField("expect_no_answer", T.BooleanType()),
        T.StructField("notes", T.StringType()),
    ]
)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, bytes, mtime, sha256, text) of the Markdown files under a folder, excluded folders left out.

    Bytes that are no UTF-8 become U+FFFD. Names that begin with a dot or underscore are hidden to Spark and not read.
    Files are listed and read in parallel; an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape(base) + "/", "")
    rel = F.url_decode(F.regexp_replace(rel, r"\+", "%2B"))
    rows = files.select(rel.alias("rel_path"), F.col("length").alias("bytes"), F.unix_micros("modificationTime").cast("double").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.expr("make_valid_utf8(CAST(content AS STRING))").alias("text"))
    return rows.withColumn("mtime", F.col("mtime") / 1e6).where(in_corpus(F.col("rel_path")))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a YAML question set (a list of mappings, a setting read on the driver)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        cases = yaml.safe_load(f) or []
    rows = [tuple((c.get(k) if k != "expected_rel_paths" else list(c.get(k) or [])) for k in GOLDEN_SCHEMA.names) for c in cases]
    return spark.createDataFrame(rows, GOLDEN_SCHEMA)


def golden_violations(golden: DataFrame) -> DataFrame:
    """(id, problem) of cases that break the schema: missing fields, unknown provenance, no expectation though an answer is expected, repeated id."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    negative = F.coalesce("expect_no_answer", F.lit(False))
    paths = F.coalesce(F.size(F.filter("expected_rel_paths", lambda p: p.isNotNull() & (p != ""))), F.lit(0))
    checks = F.array(
        F.when(blank(F.col("id")), "no id"),
        F.when(blank(F.col("question")), "no question"),
        F.when(~F.coalesce(F.col("provenance").isin(*PROVENANCE), F.lit(False)), "unknown provenance"),
        F.when(~negative & (paths <= 0), "no expectation"),
        F.when(negative & (F.col("provenance") != "negative"), "negative case of another provenance"),
    )
    broken = golden.select("id", F.explode(F.array_compact(checks)).alias("problem"))
    repeated = golden.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    return broken.unionByName(repeated)


def _local_rows(df: DataFrame, most: int) -> list[dict]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; a question set is a file kept by hand")
    return [r.asDict(recursive=True) for r in rows]


#: Cases that a question set of one file may have.
MOST_CASES = 10_000


def _replace_file(path: str, text: str) -> None:
    """Write a file beside the old one and move it there at once."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(beside, path)


def write_golden(cases: DataFrame, path: str) -> int:
    """Write cases to a YAML question set, in the order of their ids, empty fields left out; their number. ValueError beyond MOST_CASES."""
    import yaml

    rows = sorted(_local_rows(cases.select(*GOLDEN_SCHEMA.names), MOST_CASES), key=lambda r: r["id"])
    _replace_file(path, yaml.safe_dump([{k: v for k, v in r.items() if v is not None} for r in rows], allow_unicode=True, sort_keys=False))
    return len(rows)


def append_golden_file(spark: SparkSession, path: str, new: DataFrame, corpus: DataFrame) -> int:
    """Add checked cases (see ``append_golden``) to a YAML question set, which may not be there yet; the number of its cases."""
    old = read_golden(spark, path) if os.path.exists(path) else spark.createDataFrame([], GOLDEN_SCHEMA)
    negative = F.when(F.coalesce("expect_no_answer", F.lit(False)), "negative").otherwise(F.col("provenance"))
    return write_golden(append_golden(old, new.withColumn("provenance", negative), corpus), path)


def mined_cases(mined: DataFrame, profile: str = "general") -> DataFrame:
    """Mined questions (project, text, slug) as cases to be completed: ids of slug and number, provenance real, no expectation yet."""
    order = Window.partitionBy("slug").orderBy("text")
    number = F.row_number().over(order)
    case_id = F.when(number == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", number.cast("string")))
    return mined.select(
        case_id.alias("id"), F.col("text").alias("question"), F.lit(profile).alias("profile"), F.lit("real").alias("provenance"),
        F.array().cast("array<string>").alias("expected_rel_paths"), F.lit(False).alias("expect_no_answer"), F.concat(F.lit("from "), F.col("project")).alias("notes"),
    )


def append_golden(old: DataFrame, new: DataFrame, corpus: DataFrame) -> DataFrame:
    """The set with new cases added; ValueError if one breaks the schema, repeats an id, or expects a path (rel_path) that isn't in the corpus."""
    bad = golden_violations(new).limit(5).collect()
    taken = new.join(old.select("id"), "id", "left_semi").select("id").limit(5).collect()
    lost = new.select("id", F.explode("expected_rel_paths").alias("rel_path")).join(corpus.select("rel_path"), "rel_path", "left_anti").limit(5).collect()
    if bad or taken or lost:
        raise ValueError(f"violations {[tuple(r) for r in bad]}, ids in use {[r[0] for r in taken]}, unknown paths {[r[0] for r in lost]}")
    return old.unionByName(new.select(*old.columns), allowMissingColumns=True)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(project, file, line_no, text) of the user messages in JSONL transcripts. Content is a string or a list of parts, of which the texts are joined; broken lines and other events are skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("pos"))
    event = F.try_parse_json("value")
    rows = raw.select("file", "pos", event.alias("e")).where(F.col("e").isNotNull() & (F.try_variant_get("e", "$.type", "string") == "user"))
    whole = F.try_variant_get("e", "$.message.content", "string")
    parts = F.from_json(F.to_json(F.try_variant_get("e", "$.message.content", "variant")), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), " ")
    is_list = F.schema_of_variant(F.try_variant_get("e", "$.message.content", "variant")).startswith("ARRAY")
    text = F.trim(F.when(is_list, joined).otherwise(whole))
    numbered = rows.select(F.element_at(F.split("file", "/"), -2).alias("project"), "file", F.row_number().over(Window.partitionBy("file").orderBy("pos")).alias("line_no"), text.alias("text"))
    return numbered.where(F.coalesce(F.col("text"), F.lit("")) != "")


def last_prompts(messages: DataFrame, most: int = 64) -> DataFrame:
    """(file, summary): the last message of each transcript, white space collapsed, cut."""
    last = messages.groupBy("file").agg(F.max_by("text", "line_no").alias("text"))
    return last.select("file", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, most).alias("summary"))


def is_noise(text) -> F.Column:
    """Whether a message is tool output or pasted text: a marker at the start, injected context, more than six line feeds, more than 600 characters. The raw text is tested."""
    start = text.rlike(r"\A(?:<|\[Request interrupted|Caveat:|#|```)")
    return start | F.contains(text, F.lit("tool_use_id")) | F.contains(text, F.lit("system-reminder")) | (F.regexp_count(text, F.lit("\n")) > 6) | (F.length(text) > 600)


# The shape of a question, and beginnings of a command.
QUESTION_SHAPE = r"(?i)^\s*(?:how|what|why|when|where|which|who|can |could |does |do |is |are |should |would |any way|anyone know|is there|whats|what's|i (?:need|want|am trying|can't|cannot|dont|don't))"
COMMANDS = r"(?i)\A(?:run |fix |continue|go ahead|proceed|do it|make |add |remove |delete |create |write |update |commit|push|yes|no|ok|okay|thanks|please continue|next|stop|read |open |show me the file|let's |lets |can you also|now |then |also |и |test |check the |install |build |start |restart|kill |git |npm |undo|revert|retry)"


def mined_questions(messages: DataFrame, domain: str, meta: str | None = None, least_words: int = 4) -> DataFrame:
    """(project, text, slug) of messages that are questions about a domain.

    ``domain`` and ``meta`` are patterns of words that must and must not be in the text. Noise, commands and messages
    outside ``least_words`` to 60 words are dropped; of messages alike in their first 80 letters the first is kept.
    """
    from skarn.functions.text import dedupe_key, words

    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    n = F.size(words(F.col("clean")))
    asked = F.col("clean").rlike(QUESTION_SHAPE) | F.rtrim("clean").endswith("?")
    rows = messages.where(~is_noise(F.col("text"))).withColumn("clean", clean).where(n.between(least_words, 60) & ~F.col("clean").rlike(COMMANDS) & F.col("clean").rlike(domain) & asked)
    if meta:
        rows = rows.where(~F.col("clean").rlike(meta))
    first = rows.groupBy(dedupe_key(F.col("clean")).alias("k")).agg(F.min(F.struct("file", "line_no", "project", "clean")).alias("v"))
    return first.select("v.project", F.col("v.clean").alias("text"), slug(F.col("v.clean")).alias("slug"))


def read_path_list(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(rel_path) of a list of paths, one per line; ValueError if one isn't in the manifest."""
    wanted = spark.read.text(path).select(F.trim("value").alias("rel_path")).where("rel_path != ''").distinct()
    missing = [r[0] for r in wanted.join(manifest.select("rel_path"), "rel_path", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"paths that are not in the manifest: {missing}")
    return wanted


def destination(name: str, folder: str = "raw/inbox") -> str:
    """A checked path for an ingested file; ValueError for an empty, absolute, climbing or NUL path, or a wrong suffix."""
    path = PurePosixPath(name)
    if not name.strip() or "\0" in name or path.is_absolute() or ".." in path.parts or path.suffix.lower() not in SUFFIXES:
        raise ValueError(f"not a path that can be ingested: {name!r}")
    return str(path if len(path.parts) > 1 else PurePosixPath(folder) / path)


def literal_document(spark: SparkSession, content: str | None = None, path: str | None = None, filename: str | None = None) -> DataFrame:
    """One document (rel_path, text) from a text or a local file: exactly one of both, a text needs a file name, 2 MiB at most."""
    if (content is None) == (path is None):
        raise ValueError("give either content or path")
    if content is not None and not filename:
        raise ValueError("content needs a filename")
    if path is not None:
        with open(path, "rb") as f:
            raw = f.read(MOST_BYTES + 1)
        content = raw.decode("utf-8", "replace")
    if len(content.encode("utf-8")) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes")
    return spark.createDataFrame([(destination(filename or PurePosixPath(path).name), content)], "rel_path string, text string")


class Snapshots:
    """A table kept as written snapshots with a pointer to the current one: readers see the old one until the new one is whole.

    With a key, the table is cut into ``buckets`` by its hash; a snapshot lists a folder for each bucket, and replacing
    the rows of some keys writes anew only the buckets that hold one of them. The pointer is moved by one atomic rename.
    """

    def __init__(self, spark: SparkSession, root: str, key: str | None = None, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets if key else 1
        self._pointer = f"{self.root}/CURRENT"

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        path = self._path(self._pointer)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _lines(self, name: str) -> list[str]:
        return [r[0] for r in self.spark.read.text(name).collect()]

    def current(self) -> str | None:
        return self._lines(self._pointer)[0] if self._fs().exists(self._path(self._pointer)) else None

    def _folders(self, name: str) -> dict[int, str]:
        """The folder of each bucket that a snapshot has rows in."""
        return {int(b): f for b, f in json.loads(self._lines(f"{self.root}/{name}.json")[0]).items()}

    def _write(self, name: str, text: str) -> None:
        stream = self._fs().create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _point_to(self, name: str) -> None:
        """Move a whole file over the pointer: readers see the old or the new one."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        beside = f"{self._pointer}.{uuid.uuid4().hex}"
        self._write(beside, name)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(beside), self._path(self._pointer), how)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders)).drop("_bucket")

    def read(self, name: str | None = None) -> DataFrame:
        """The current snapshot, or an older one."""
        name = name or self.current()
        if name is None:
            raise FileNotFoundError(self._pointer)
        return self._read(sorted(set(self._folders(name).values())))

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def _add(self, df: DataFrame, kept: dict[int, str]) -> str:
        name = f"v-{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self._bucket())
        (rows.repartition("_bucket") if self.key else rows).write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        base = self._path(f"{self.root}/{name}")
        there = [s.getPath().getName() for s in self._fs().listStatus(base)]
        new = {int(n.split("=")[1]): f"{name}/{n}" for n in there if n.startswith("_bucket=")}
        if not new and not kept:
            # a table without rows keeps its columns
            df.limit(0).coalesce(1).write.parquet(f"{self.root}/{name}/none")
            new = {-1: f"{name}/none"}
        self._write(f"{self.root}/{name}.json", json.dumps(kept | new))
        self._point_to(name)
        return name

    def write(self, df: DataFrame) -> None:
        """Write a snapshot of the whole table, then move the pointer."""
        self._add(df, {})

    def replace(self, df: DataFrame, keys: DataFrame) -> None:
        """Replace the rows of the given keys by the new rows, whose keys must be among them. Only buckets that hold one of the keys are read and written."""
        if self.key is None:
            raise ValueError("rows are replaced by key")
        if self.current() is None:
            return self.write(df)
        folders = self._folders(self.current())
        touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        old = [f for b, f in folders.items() if b in touched]
        kept = {b: f for b, f in folders.items() if b not in touched and b >= 0}
        rest = self._read(old).join(keys.select(self.key).distinct(), self.key, "left_anti") if old else None
        self._add(df if rest is None else rest.unionByName(df), kept)

    def rollback(self, name: str) -> None:
        """Make an older snapshot the current one."""
        self._folders(name)
        self._point_to(name)

    def cleanup(self) -> int:
        """Delete the folders and lists that the current snapshot does not use; their number."""
        name = self.current()
        used = {f.split("/")[0] for f in self._folders(name).values()} if name else set()
        gone = 0
        for status in self._fs().listStatus(self._path(self.root)):
            found = status.getPath().getName()
            if found.startswith("v-") and found not in used and found != f"{name}.json":
                self._fs().delete(status.getPath(), True)
                gone += 1
        return gone
