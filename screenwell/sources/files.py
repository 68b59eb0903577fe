"""Scans of logs, molecule lists, sequences, alignments, dimensions and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from ..functions.columns import col, strip_nulls
from ..operators.ordering import running_sum
from ..runtime import attach
from .. import schemas

CORRUPT = "_malformed"


def _loose(schema: T.StructType) -> T.StructType:
    """Scalars as text, so one odd value does not cost the whole record."""
    fields = [T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                            else T.StringType()) for f in schema.fields]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def _typed(df: DataFrame, schema: T.StructType, *extra: str) -> DataFrame:
    cols = [F.col(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cols, *extra)


def as_schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _json(reader, path, schema, keep_malformed):
    want = as_schema(schema)
    raw = (reader.schema(_loose(want)).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    if keep_malformed:
        return _typed(raw, want, CORRUPT)
    return _typed(raw.filter(F.col(CORRUPT).isNull()), want)


def read_log(spark: SparkSession, path, schema=schemas.SCORE_LOG, keep_malformed: bool = False) -> DataFrame:
    """An append-only JSON-lines log; lines that do not parse are dropped, or kept for counting."""
    return _json(spark.read, path, schema, keep_malformed)


def stream_log(spark: SparkSession, path, schema=schemas.SCORE_LOG, files_per_trigger: int | None = None) -> DataFrame:
    """The same log as a stream of newly landed files."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _json(reader, path, schema, False)


def molecules_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """First token of each line; blank lines and a header starting with 'smiles' are skipped."""
    token = F.split(F.trim(F.col(line)), r"\s+")[0]
    return (lines.withColumn("smiles", token)
            .filter((F.col("smiles") != "") & ~F.lower(F.col("smiles")).startswith("smiles")))


def read_smi(spark: SparkSession, path, last_letters: str | None = None,
             tranches: list[str] | None = None) -> DataFrame:
    """Molecule line files of four-letter tranches; whole files are skipped by both filters.

    Files are named after their tranche (AAAB.smi) or lie in folders tranche=AAAB. `tranches` keeps
    codes that begin with one of the letter pairs, `last_letters` codes that end in one of the letters.
    """
    lines = spark.read.text(path)
    if "tranche" in lines.columns:
        lines = lines.select("value", F.col("_metadata.file_name").alias("file"), "tranche")
    else:
        reader = spark.read.option("pathGlobFilter", f"*[{last_letters}].smi") if last_letters else spark.read
        lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("file"))
        lines = lines.withColumn("tranche", F.substring("file", 1, 4))
    if last_letters:
        lines = lines.filter(F.substring("tranche", 4, 1).isin(*last_letters))
    if tranches:
        lines = lines.filter(F.substring("tranche", 1, 2).isin(*tranches))
    return molecules_of(lines).select("smiles", "tranche", "file")


def _records(spark: SparkSession, path) -> DataFrame:
    """FASTA-like files cut at line-initial '>': one row per record with its place in the file."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    folders = [c for c in raw.columns if c != "value"]
    return (raw.select(*folders, F.col("_metadata.file_name").alias("file"),
                       F.col("_metadata.file_block_start").alias("__at"),
                       F.monotonically_increasing_id().alias("__seq"),
                       F.regexp_replace(strip_nulls("value"), r"^>", "").alias("__rec"))
            .filter(F.trim("__rec") != ""))


def _parts() -> tuple[Column, Column]:
    lines = F.split("__rec", r"\r?\n")
    body = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda s: F.trim(s)), lambda s: s != "")
    return F.trim(lines[0]), F.array_join(body, "")


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """One row per sequence: file, header, sequence."""
    header, sequence = _parts()
    return _records(spark, path).select("file", header.alias("header"), sequence.alias("sequence"))


def read_a3m(spark: SparkSession, path, key: str = "uniprot_id", **how) -> DataFrame:
    """Alignments, one row per sequence with its 0-based position.

    Each file is named after its key, or lies in a folder key=value. Files are split and read in
    parallel; the position comes from the split's offset and the order inside it.
    """
    header, sequence = _parts()
    rows = _records(spark, path)
    if key not in rows.columns:
        rows = rows.withColumn(key, F.regexp_replace("file", r"\.a3m$", ""))
    rows = rows.select(key, "file", "__at", "__seq", header.alias("header"), sequence.alias("sequence"))
    # A task numbers one split, however long its alignment is; only counts of splits are carried on.
    split = [key, "file", "__at"]
    sizes = running_sum(rows.groupBy(*split).agg(F.count(F.lit(1)).alias("__n")), "__n", ["file", "__at"], [key], "__upto", **how)
    placed = attach(rows.withColumn("__pos", F.row_number().over(W.partitionBy(*split).orderBy("__seq"))), sizes, split, "inner")
    return placed.select(F.col(key).cast("string").alias(key), (F.col("__pos") + F.col("__upto") - F.col("__n") - 1).cast("int").alias("pos"), "header", "sequence")


def read_targets(spark: SparkSession, path, threshold: float = -7.0, tier: int = 9, whole_files: bool = True) -> DataFrame:
    """The target dimension with defaults for a missing threshold and tier.

    A file is one JSON array, or with whole_files=False a JSON array or object per line.
    """
    raw = spark.read.schema(as_schema(schemas.TARGETS)).option("multiLine", whole_files).json(path)
    return target_defaults(raw, threshold, tier)


def target_defaults(targets: DataFrame, threshold: float = -7.0, tier: int = 9) -> DataFrame:
    return (targets.withColumn("target_score_threshold",
                               F.coalesce("target_score_threshold", F.lit(threshold)))
            .withColumn("difficulty_tier", F.coalesce("difficulty_tier", F.lit(tier))))


def read_reference_compounds(spark: SparkSession, path, whole_files: bool = True) -> DataFrame:
    """One reference molecule per target; the last entry of the document wins."""
    raw = spark.read.schema(as_schema(schemas.REFERENCE_COMPOUNDS)).option("multiLine", whole_files).json(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return last_compound(raw.select("compounds", at.alias("at")))


def last_compound(documents: DataFrame) -> DataFrame:
    """The last compound of every target by (`at`, place in the document); `at` orders the documents."""
    return (documents.select("at", F.posexplode("compounds").alias("pos", "c"))
            .groupBy(F.col("c.target_id").alias("target_id"))
            .agg(F.max_by("c.smiles", F.struct("at", "pos")).alias("smiles")))


def read_activity_pages(spark: SparkSession, path) -> DataFrame:
    """One row per activity of every landed response page."""
    raw = spark.read.schema(as_schema(schemas.ACTIVITY_PAGES)).json(path)
    return raw.select(F.inline("activities"))


def parse_telemetry(lines: DataFrame, line: str = "value") -> DataFrame:
    """Device lines 'power, use, temperature, memory used, memory total, name'.

    The name may hold commas; a line without numeric power is dropped.
    """
    part = F.split(F.col(line), ",", 6)
    number = lambda i: F.regexp_extract(F.trim(F.get(part, F.lit(i))),
                                        r"^[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("double")
    return (lines.withColumn("power_draw", number(0)).withColumn("gpu_util", number(1))
            .withColumn("temperature", number(2)).withColumn("memory_used", number(3))
            .withColumn("memory_total", number(4))
            .withColumn("name", F.trim(F.get(part, F.lit(5)))).drop(line)
            .filter(F.col("power_draw").isNotNull()))


def list_files(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """Folder, name and size of every file; contents are never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(path)
            .select(F.element_at(F.split("path", "/"), -2).alias("folder"),
                    F.element_at(F.split("path", "/"), -1).alias("file"), "length"))


def file_inventory(files: DataFrame, least: int = 1024) -> DataFrame:
    """Number of usable files and their smallest, largest and mean size."""
    size = F.when(F.col("length") >= least, F.col("length"))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.count(size).alias("n_valid"),
                     F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"),
                     F.avg(size).alias("avg_bytes"))


# Fixed value: headers of the query itself in an alignment.
QUERY_HEADER = "^(query|101)$"


def merge_msa(primary: DataFrame, secondary: DataFrame, key: str = "uniprot_id") -> DataFrame:
    """Primary alignment, then the secondary from its first record on that is not a query record.

    Query records later in the secondary stay. A key that only one side holds comes from that side whole.
    """
    depth = primary.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hit = ~F.coalesce(F.trim("header").rlike(QUERY_HEADER), F.lit(False))
    first = secondary.filter(hit).groupBy(key).agg(F.min("pos").alias("__first"))
    shifted = (attach(attach(secondary, depth, [key]), first, [key])
               .filter(F.col("__n").isNull() | (F.col("pos") >= F.col("__first")))
               .withColumn("pos", F.when(F.col("__n").isNull(), F.col("pos"))
                           .otherwise(F.col("pos") - F.col("__first") + F.col("__n")).cast("int")).drop("__n", "__first"))
    return (primary.withColumn("origin", F.lit("primary"))
            .unionByName(shifted.withColumn("origin", F.lit("secondary"))))


def msa_depth(alignments: DataFrame, key: str = "uniprot_id") -> DataFrame:
    """Sequences and residues per alignment."""
    return alignments.groupBy(key).agg(F.count(F.lit(1)).alias("depth"),
                                       F.sum(F.length("sequence")).alias("residues"))


def lines_of(df: DataFrame, text) -> DataFrame:
    return df.select(col(text).alias("value"))
