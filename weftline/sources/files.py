"""File sources and sinks, always with explicit schemas."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordinal import with_ordinal

NODESET = (
    "nodes array<struct<nodeID: string, text: string, type: string>>, edges array<struct<edgeID: string, fromID: string, toID: string>>, "
    "locutions array<struct<nodeID: string, personID: string, start: string, timestamp: string>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Typed lines; blank ones are skipped, a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_nodesets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Argument maps, a JSON document per file, as flat tables: nodes, edges, locutions and defects.

    Defects are repeated node ids, edges with an unknown end, and locution
    records of unknown, repeated or other nodes; of repeated records the first counts.
    """
    raw = spark.read.schema(NODESET).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\w+)\.json$", 1).alias("map_id"), "*")
    nodes = raw.select("map_id", F.posexplode("nodes").alias("node_index", "n")).select("map_id", "node_index", F.col("n.nodeID").alias("node_id"), "n.type", "n.text")
    edges = raw.select("map_id", F.posexplode("edges").alias("edge_index", "e")).select("map_id", "edge_index", F.col("e.fromID").alias("from_id"), F.col("e.toID").alias("to_id"))
    records = raw.select("map_id", F.posexplode("locutions").alias("record", "l")).select("map_id", "record", F.col("l.nodeID").alias("node_id"), F.col("l.personID").alias("person_id"), "l.start", "l.timestamp")
    spoken = nodes.where("type = 'L'").select("map_id", "node_id")
    known = records.join(spoken, ["map_id", "node_id"])
    first = known.groupBy("map_id", "node_id").agg(F.min_by(F.struct("person_id", "start", "timestamp"), "record").alias("r"), F.count(F.lit(1)).alias("k"))
    kind = lambda name, df: df.select("map_id", F.lit(name).alias("defect"), "node_id")
    ends = edges.select("map_id", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    defects = kind("repeated node", nodes.groupBy("map_id", "node_id").count().where("count > 1"))
    defects = defects.unionByName(kind("dangling edge", ends.join(nodes, ["map_id", "node_id"], "left_anti")))
    defects = defects.unionByName(kind("stray locution", records.join(spoken, ["map_id", "node_id"], "left_anti"))).unionByName(kind("repeated locution", first.where("k > 1")))
    return {"nodes": nodes, "edges": edges, "locutions": first.select("map_id", "node_id", "r.*"), "defects": defects}


def unexpected_keys(texts: DataFrame, id_col: str, text_col: str, form: dict) -> DataFrame:
    """(id, path, key, problem) of JSON objects that don't have exactly the keys of ``form``, at any depth.

    ``form`` is a dict of keys; a value of None takes anything, a dict an object
    and a list of one dict an array of objects.  Keys that end in ``?`` may be
    left out.  Texts that aren't JSON, or repeat a key, have problem ``not
    JSON``; other values where an object or array is due have ``not an object``
    or ``not an array``.  Each level is one lateral explode of variants.
    """
    spark = texts.sparkSession
    top = texts.select(F.col(id_col).alias("id"), F.try_parse_json(text_col).alias("v"))
    found = [top.where("v IS NULL").select("id", F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.lit("not JSON").alias("problem"))]

    def kind(v: str, of: str) -> Column:
        return F.schema_of_variant(v).startswith(of)

    def walk(objects: DataFrame, path: str, keys: dict) -> None:
        """``objects`` has (id, place, v): a variant for each object at this path."""
        found.append(objects.where(~kind("v", "OBJECT")).select("id", F.lit(path).alias("path"), F.lit(None).cast("string").alias("key"), F.lit("not an object").alias("problem")))
        sound = objects.where(kind("v", "OBJECT"))
        names = [k.removesuffix("?") for k in keys]
        fields = sound.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).select("id", "place", "key", F.col("value").alias("v"))
        told = lambda df, problem: df.select("id", F.lit(path).alias("path"), "key", F.lit(problem).alias("problem"))
        found.append(told(fields.where(F.col("key").isNotNull() & ~F.col("key").isin(names)), "unexpected"))
        must = [k for k in keys if not k.endswith("?")]
        have = fields.groupBy("id", "place").agg(F.collect_set("key").alias("keys"))
        found.append(told(have.select("id", F.explode(F.array_except(F.array(*map(F.lit, must)).cast("array<string>"), "keys")).alias("key")), "missing"))
        for name, form in keys.items():
            name = name.removesuffix("?")
            own = fields.where(F.col("key") == name)
            if isinstance(form, dict):
                walk(own.select("id", F.concat_ws("/", "place", F.lit(name)).alias("place"), "v"), f"{path}.{name}", form)
            elif isinstance(form, list):
                found.append(told(own.where(~kind("v", "ARRAY")), "not an array"))
                items = own.where(kind("v", "ARRAY")).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("id", F.concat_ws("/", "place", F.lit(name), F.col("pos").cast("string")).alias("place"), F.col("value").alias("v"))
                walk(items, f"{path}.{name}[]", form[0])

    walk(top.where("v IS NOT NULL").withColumn("place", F.lit("")), "$", form)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# The keys of an argument map's file; what stands in a node, an edge or a locution is open.
MAP_FORM = {"nodes": None, "edges": None, "locutions": None}


def load_maps(spark: SparkSession, path: str, metadata: DataFrame) -> dict[str, DataFrame]:
    """The tables of :func:`read_nodesets`, and ``maps``: (map_id, dialogue_id, place) in the order of dialogue, map and id.

    ``metadata`` has (map_id, dialogue_id, dialogue_order, map_order).  Files of
    other keys, maps without metadata, metadata without a map, repeated node ids
    and edges to unknown nodes are errors that name the first twenty.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\w+)\.json$", 1).alias("map_id"), "value")
    wrong = unexpected_keys(files, "map_id", "value", MAP_FORM).limit(20).collect()
    if wrong:
        raise ValueError("maps of another form: " + ", ".join(f"{r.id} {r.path} {r.key or ''} {r.problem}" for r in wrong))
    ids = files.select("map_id")
    apart = ids.join(metadata, "map_id", "left_anti").select("map_id", F.lit("has no metadata").alias("problem")).unionByName(metadata.join(ids, "map_id", "left_anti").select("map_id", F.lit("has no file").alias("problem")))
    tables = read_nodesets(spark, path)
    broken = tables["defects"].where("defect IN ('repeated node', 'dangling edge')").select("map_id", F.concat_ws(" ", F.lit("has a"), "defect", "node_id").alias("problem"))
    faults = apart.unionByName(broken).limit(20).collect()
    if faults:
        raise ValueError("maps can't be loaded: " + ", ".join(f"{r.map_id} {r.problem}" for r in faults))
    order = [F.col(c) for c in ("dialogue_order", "map_order", "map_id")]
    maps = with_ordinal(metadata.join(ids, "map_id"), order, "place").select("map_id", "dialogue_id", "place")
    return {**tables, "maps": maps}


def read_debates(spark: SparkSession, path: str, text_columns: tuple[str, ...] = ("ADU_EN", "ADU_ES", "ADU_CAT")) -> DataFrame:
    """CSV rows with a known stance; text is the first non-empty translation with white space collapsed."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    stance = F.upper(F.trim("TEAM STANCE"))
    text = F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.col(c), r"(?U)[\s\x1c-\x1f]+", " ")), F.lit("")) for c in text_columns if c in rows.columns])
    return rows.withColumn("stance", stance).where(F.col("stance").isin("FAVOUR", "AGAINST")).withColumn("side", F.when(F.col("stance") == "FAVOUR", "AFF").otherwise("NEG")).withColumn("text", text)


def relation_slots(rows: DataFrame, id_col: str, related: str, kind: str) -> DataFrame:
    """Wide columns ``related``, ``related.1``, ... with their ``kind`` partners as rows (id, slot, related, kind); empty slots are left out."""
    slots = sorted((int(m[1] or 0), c) for c in rows.columns if (m := re.fullmatch(re.escape(related) + r"(?:\.(\d+))?", c)))
    partner = lambda k: kind if k == 0 else f"{kind}.{k}"
    each = F.array(*[F.struct(F.lit(k).alias("slot"), F.nullif(F.trim(f"`{c}`"), F.lit("")).alias("related"), F.nullif(F.trim(f"`{partner(k)}`"), F.lit("")).alias("kind")) for k, c in slots])
    return rows.select(F.col(id_col).alias("id"), F.explode(each).alias("s")).select("id", "s.*").where("related IS NOT NULL OR kind IS NOT NULL")


def related_ids(related: Column) -> Column:
    """Whole numbers of a ``;`` list, where ``85.0`` is 85; null when any part is something else."""
    parts = F.transform(F.split(related, ";"), lambda x: F.regexp_extract(F.trim(x), r"^(\d+)(?:\.0+)?$", 1))
    return F.when(~F.exists(parts, lambda x: x == ""), parts.cast("array<bigint>"))


def write_ordered_jsonl(rows: DataFrame, order: list[str], path: str) -> None:
    """Lines in order, over as many files as there are ranges; nulls are written."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("ignoreNullFields", False).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file under a folder; for manifests and frozen-artifact checks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def numbered_lines(spark: SparkSession, path: str, pick: Callable[[str | None], object] | None = None) -> DataFrame:
    """(path, line, value) of text files of any size, numbered from 1 in each; with ``pick`` only lines of which it makes something, and that as the value.

    Files are split as Spark splits them; a task counts the lines of its splits
    as they come, and the lines of the splits before are added from one count a
    split.  ``pick`` gets None for a line that isn't UTF-8.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True))
            rows = []
            for key, raw in zip(keys, batch.column("value").to_pylist(), strict=True):
                at[key] = at.get(key, 0) + 1
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    text = None
                value = text if pick is None else pick(text)
                if pick is None or value is not None:
                    rows.append((*key, at[key], value))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "start", "own", "value"])

    sizes = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("path", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # a row per split
    told = lines.mapInArrow(run, "path string, start long, own long, value string")
    return told.join(before, ["path", "start"]).select("path", (F.col("own") + F.col("before")).alias("line"), "value")


def jsonl_errors(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """(path, line, error) of lines that are no JSON object of exactly these fields; blank lines count, but are no error.

    ``fields`` names the JSON type of each: string, number, integer, boolean,
    array or object, with ``?`` behind it where null is allowed.
    """
    kinds = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,)}

    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("a key is repeated")
        return out

    def error(line: str | None) -> str | None:
        if line is None:
            return "not UTF-8"
        if not line.strip():
            return None
        try:
            row = json.loads(line, object_pairs_hook=unique)
        except (ValueError, RecursionError) as e:
            return f"not JSON: {e}"
        if not isinstance(row, dict):
            return "not an object"
        if set(row) != set(fields):
            return f"fields are {', '.join(sorted(row))}"
        for name, kind in fields.items():
            value, types = row[name], kinds[kind.rstrip("?")]
            if not (value is None and kind.endswith("?")) and (not isinstance(value, types) or (isinstance(value, bool) and bool not in types)):
                return f"{name} is no {kind.rstrip('?')}"
        return None

    return numbered_lines(spark, path, error).withColumnRenamed("value", "error")


def repeats_keys(text: Column) -> Column:
    """Whether a JSON text is sound but for an object that holds a key twice."""
    return F.try_parse_json(text).isNull() & F.get_json_object(text, "$").isNotNull()


def schema_version(spark: SparkSession, path: str) -> str | None:
    """``schema_version`` of a file's first line that isn't blank."""
    row = spark.read.text(path).where("trim(value) <> ''").limit(1).select(F.get_json_object("value", "$.schema_version")).head()
    return row and row[0]


def schema_json(df: DataFrame) -> str:
    """The schema of a table, keys sorted, for a contract beside its files."""
    return json.dumps(json.loads(df.schema.json()), sort_keys=True, indent=2)


def manifest_json(counts: DataFrame, files: DataFrame, **more: object) -> str:
    """A manifest: one row of counts, the digests of the files by path, and what else is given; keys sorted."""
    told = {r["path"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in files.select("path", "bytes", "sha256").collect()}  # a row per file of a package
    return json.dumps({"counts": counts.head().asDict(), "files": told, **more}, sort_keys=True, indent=2)


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows) of each file under a folder: rows of Parquet, lines that aren't blank of JSON lines and CSV but for its header; no rows for others.

    Files without a byte aren't seen.
    """
    one = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("path")  # noqa: E731  # readers write file:/ or file:///
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(one("path"))
    of = lambda *ends: F.coalesce(*[F.when(F.col("path").endswith(e), True) for e in ends], F.lit(False))
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,csv}").text(path).where("trim(value) <> ''").groupBy(one(F.col("_metadata.file_path"))).agg(F.count(F.lit(1)).alias("n"))
    text = text.withColumn("n", F.when(F.col("path").endswith(".csv"), F.col("n") - 1).otherwise(F.col("n")))
    out = files.join(text, "path", "left").withColumn("rows", F.when(of(".jsonl", ".csv"), F.coalesce("n", F.lit(0)))).select("path", "rows")
    if files.where(of(".parquet")).isEmpty():
        return out
    tables = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path).groupBy(one(F.col("_metadata.file_path"))).agg(F.count(F.lit(1)).alias("n"))
    return out.join(tables, "path", "left").select("path", F.when(of(".parquet"), F.coalesce("n", F.lit(0))).otherwise(F.col("rows")).alias("rows"))


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte under a folder, which Spark's readers pass over."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    out = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            out.append(f.getPath().toString())
    return out


def package_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, rows) of each file of a package, paths from its folder on; files without a byte are among them."""
    root = path.rstrip("/")
    one = F.regexp_replace("path", "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("path")
    inside = F.regexp_replace(F.col("path"), F.lit("^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", root)) + "/"), F.lit(""))
    digests = file_digests(spark, root).select(one, "bytes", "sha256")
    out = digests.join(row_counts(spark, root), "path")
    empty = [(p, 0, hashlib.sha256().hexdigest(), 0 if p.endswith((".jsonl", ".csv")) else None) for p in empty_files(spark, root)]
    if empty:
        out = out.unionByName(spark.createDataFrame(empty, out.schema))
    return out.withColumn("path", inside)


def manifest_differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state) of files that are missing, undeclared, changed or miscounted against a manifest; no rows when all agree.

    Both have path, bytes and sha256.  If the manifest has rows as well, so must
    ``found``: a file whose bytes agree, but whose declared rows aren't what it
    holds, is miscounted; files declared without rows aren't counted.
    """
    counted = "rows" in manifest.columns
    m = manifest.select("path", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha256"), (F.col("rows") if counted else F.lit(None).cast("long")).alias("m_rows"))
    both = found.join(m, "path", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha256").isNull(), "undeclared").when((F.col("sha256") != F.col("m_sha256")) | (F.col("bytes") != F.col("m_bytes")), "changed")
    if counted:
        state = state.when(F.col("m_rows").isNotNull() & ~F.col("rows").eqNullSafe(F.col("m_rows")), "miscounted")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")
