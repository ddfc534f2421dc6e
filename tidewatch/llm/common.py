"""Helpers the operators of this package share: tables between stages, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import remove, run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


class Stored:
    """A frame written once to the shared folder and read back from there."""

    def __init__(self, df: DataFrame, label: str, compression: str | None = None):
        self.spark = df.sparkSession
        self.path = run_dir(self.spark, label)
        df.write.parquet(self.path, compression=compression)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame, label: str) -> DataFrame:
    return Stored(df, label).df


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` whose id and text are those of a row of `kept` (doc_id, text_sha256), each once.

    Texts move once, when rows meet the list. Rows that repeat an id and text differ at most in other columns; one of
    them stays, and within a task the others go before the shuffle.
    """

    def key(doc_id: Column, digest: Column) -> Column:
        return F.concat_ws(":", digest, F.coalesce(doc_id.cast("string"), F.lit("null")))

    listed = kept.select(key(F.col("doc_id"), F.col("text_sha256")).alias("_key")).distinct()
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    keyed = docs.select(row, key(F.col(id_col).cast("long"), F.sha2(whole(text_col), 256)).alias("_key"))
    once = Window.partitionBy("_key").orderBy(*[F.col("_row")[c].cast("string") for c in docs.columns if c != text_col])
    return keyed.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").join(listed, "_key", "left_semi").select("_row.*")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, for every node that has an edge: (node, component).

    edges: (a long, b long), any direction, repeats allowed. Each round every node hooks onto its smallest neighbour,
    chains of hooks are halved twice, and the graph is contracted along them; at least half of the linked nodes go in
    a round. Every input of a join is a written table, so neither side is already dealt by the key and a node with very
    many edges can be split between tasks. No edge or node passes through the driver.
    """
    live = Stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not live.df.isEmpty():
        both = live.df.unionByName(live.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = Stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up")), "hooks")
        for _ in range(2):
            # A root of the hooks is its own smallest neighbour, so every `up` is a node of the table.
            longer = Stored(_follow(hooks.df, "up", hooks.df), "hooks")
            hooks.drop()
            hooks = longer
        fewer = Stored(_follow(_follow(live.df, "a", hooks.df), "b", hooks.df).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        live.drop()
        live = fewer
        if labels is None:
            labels = Stored(hooks.df.select("node", F.col("up").alias("component")), "labels")
        else:
            newer = Stored(_follow(labels.df, "component", hooks.df), "labels")
            labels.drop()
            labels = newer
        hooks.drop()
    live.drop()
    return labels.df if labels else edges.sparkSession.createDataFrame([], "node long, component long")


def _follow(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """Replace a column of node ids by what they hook onto; ids without a hook stay."""
    to = hooks.select(F.col("node").alias("_from"), F.col("up").alias("_to"))
    return df.join(to, df[column] == to["_from"], "left").select(*[F.coalesce("_to", column).alias(column) if c == column else df[c] for c in df.columns])
