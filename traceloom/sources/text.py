"""Text forms of logs, directly-follows graphs and models.

Log:   `trace_id,activity,activity,...`   one trace per line
Graph: `src,(dst,n),(dst,n),...`          one source activity per line
Model: DOT graph, one node or edge per line

Activity names with commas or parentheses do not survive the first two forms;
Parquet tables do not have that limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators.gateways import gateway_nodes
from traceloom.operators.ordering import MAX_CASE_EVENTS, rank_by_range
from traceloom.schema import ALL, AND
from traceloom.session import materialize

# Fixed formats.
ARC_PATTERN = r"\(([^,]*),([0-9]+)\)"
ARC_FORMAT = "(%s,%d)"


#: The folder Spark writes for an empty name (fixed value).
NO_NAME = "__HIVE_DEFAULT_PARTITION__"

# Where a line stands: Spark numbers the lines of a block in reading order.
LINE_ORDER = ["file", "block", "line"]


def parse_traces(lines: DataFrame, model_id: str = ALL) -> DataFrame:
    """Lines (`value`) as `model_id, case_id, activities`. Trailing empty names vanish."""
    other = [c for c in lines.columns if c != "value"]
    fields = F.split(F.regexp_replace("value", ",+$", ""), ",")
    return lines.select(F.lit(model_id).alias("model_id"), fields.alias("fields"), *other).select(
        "model_id",
        F.element_at("fields", 1).alias("case_id"),
        F.slice("fields", F.lit(2), F.size("fields")).alias("activities"),
        *other,
    )


def read_traces(
    spark: SparkSession,
    path: str,
    partitions: int | None = None,
    model_id: str = ALL,
    line_order: bool = False,
) -> DataFrame:
    """Read a text log; `partitions` asks for at least that many.

    Files are split as the session's settings say, and these are left as they are; a
    log that comes in fewer splits is dealt out anew.

    `line_order` adds columns (`LINE_ORDER`) that sort the traces as in the files.
    """
    lines = spark.read.text(path)
    if line_order:
        lines = lines.select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        )
    if partitions and lines.rdd.getNumPartitions() < partitions:
        lines = lines.repartition(partitions)
    return parse_traces(lines, model_id)


def trace_lines(traces: DataFrame) -> DataFrame:
    """Traces as lines (`value`)."""
    return traces.select(F.concat_ws(",", "case_id", "activities").alias("value"))


def write_traces(traces: DataFrame, path: str) -> None:
    trace_lines(traces).write.text(path)


def replicate_log(traces: DataFrame, copies: int, order: list[str] | None = None) -> DataFrame:
    """The log repeated `copies` times, renumbered 0.. along `order` (default: case id).

    Copy r of the trace at position p gets the id r * (number of traces) + p.
    No copies make an empty log.
    """
    if copies < 0:
        raise ValueError("copies can't be negative")
    sizes = materialize(traces.groupBy("model_id").agg(F.count("*").alias("n_traces")), "sizes")
    rows = sizes.agg(F.sum("n_traces")).first()[0] or 0
    numbered = rank_by_range(traces, ["model_id"], order or ["case_id"], rows, MAX_CASE_EVENTS)
    return (
        numbered.join(sizes, "model_id")
        .withColumn("copy", F.explode(F.slice(F.sequence(F.lit(0), F.lit(copies)), 1, copies)))
        .select(
            "model_id",
            (F.col("copy") * F.col("n_traces") + F.col("pos") - 1).cast("string").alias("case_id"),
            "activities",
        )
    )


def adjacency_lines(dfg: DataFrame) -> DataFrame:
    """The graph of each model as lines: `model_id, value`."""
    arcs = F.sort_array(F.collect_list(F.struct("dst", "n")))
    return (
        dfg.groupBy("model_id", "src")
        .agg(F.transform(arcs, lambda x: F.format_string(ARC_FORMAT, x["dst"], x["n"])).alias("arcs"))
        .select("model_id", F.concat_ws(",", "src", "arcs").alias("value"))
    )


def write_dfg(dfg: DataFrame, path: str) -> None:
    """Write the graphs of all models as text, a folder `model_id=...` for each.

    `dfg` is evaluated once; `read_dfg` finds the models again by their folders.
    """
    adjacency_lines(dfg).select("model_id", "value").write.partitionBy("model_id").text(path)


def parse_dfg(lines: DataFrame, model_id: str = ALL) -> DataFrame:
    """Adjacency lines (`value`) as `model_id, src, dst, n`; lines may name their `model_id`."""

    def captured(group: int) -> Column:
        return F.regexp_extract_all("value", F.lit(ARC_PATTERN), F.lit(group))

    arcs = F.arrays_zip(captured(1).alias("dst"), captured(2).alias("n"))
    model = F.col("model_id") if "model_id" in lines.columns else F.lit(model_id).alias("model_id")
    return lines.select(
        model,
        F.substring_index("value", ",", 1).alias("src"),
        F.explode(arcs).alias("arc"),
    ).select("model_id", "src", "arc.dst", F.col("arc.n").cast("bigint").alias("n"))


def read_dfg(spark: SparkSession, path: str, model_id: str = ALL) -> DataFrame:
    """Graphs of the models that have a folder below `path`; lines without one belong to `model_id`.

    Names of models stay text, as they were written: the folder `model_id=01` is the model 01.
    """

    def decoded(name: Column) -> Column:
        return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))

    lines = spark.read.option("recursiveFileLookup", True).text(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/model_id=([^/]*)/[^/]*$", 1)
    # Spark escapes a name in its folder, and the folder in the path; an empty name has a folder of its own.
    name = decoded(decoded(folder))
    model = F.when(folder == "", model_id).when(name == NO_NAME, "").otherwise(name)
    return parse_dfg(lines.select("value", model.alias("model_id")))


def _quoted(name: Column) -> Column:
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def model_lines(model: DataFrame) -> DataFrame:
    """A model as DOT lines: `model_id, section, line`.

    Sections in order: 0 header, 1 gateways, 2 precise edges, 3 fuzzy edges, 4 end.
    """
    gateways = gateway_nodes(model).select(
        "model_id",
        F.lit(1).alias("section"),
        F.concat(
            _quoted(F.col("node")),
            F.when(F.col("kind") == AND, ' [shape=diamond,label="AND"];').otherwise(
                ' [shape=diamond,label="XOR"];'
            ),
        ).alias("line"),
    )
    precise = F.col("layer") == "precise"
    edges = model.select(
        "model_id",
        F.when(precise, 2).otherwise(3).alias("section"),
        F.concat(
            _quoted(F.col("src")),
            F.lit(" -> "),
            _quoted(F.col("dst")),
            F.when(precise, ' [color=purple,label="').otherwise(' [color=black,label="'),
            F.col("n").cast("string"),
            F.lit('"];'),
        ).alias("line"),
    )
    frame = F.array(
        F.struct(F.lit(0).alias("section"), F.lit("digraph model { node [shape=box, style=rounded]").alias("line")),
        F.struct(F.lit(4).alias("section"), F.lit("}").alias("line")),
    )
    models = model.select("model_id").distinct()
    frames = models.select("model_id", F.explode(frame).alias("f")).select("model_id", "f.*")
    return frames.unionByName(gateways).unionByName(edges)


def write_model(model: DataFrame, path: str) -> None:
    """Write models as DOT text, a folder per model; part files are in section order."""
    lines = model_lines(model).orderBy("model_id", "section", "line")
    lines.select("model_id", F.col("line").alias("value")).write.partitionBy("model_id").text(path)
