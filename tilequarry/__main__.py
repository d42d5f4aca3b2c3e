"""Command line: python -m tilequarry COMMAND; each command reads and writes files that Spark reaches."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import Raster
from .operators import ablation, catalog, evaluate, index, pooling, retrieval, synthetic
from .sources import readers, writers
from .streaming import telemetry


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilequarry", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("catalog", help="point grid to tile catalogue")
    c.add_argument("--points", required=True)
    c.add_argument("--raster", type=numbers, required=True, help="left,top,gsd,width,height")
    c.add_argument("--tile-px", type=int, default=1024)
    c.add_argument("--stride-px", type=int, default=512)
    c.add_argument("--page-size-m", type=float, default=600.0)
    c.add_argument("--order", default="tile_id")
    c.add_argument("--config-name", default="default")
    c.add_argument("--out", required=True)
    i = sub.add_parser("index", help="catalogue and embeddings to tiles, pages and coarse vectors")
    i.add_argument("--catalog", required=True)
    i.add_argument("--embeddings", required=True, help="Parquet of (tile_id, embedding)")
    i.add_argument("--out", required=True)
    q = sub.add_parser("queries", help="seeded synthetic query set")
    q.add_argument("--box", type=numbers, required=True, help="minx,miny,maxx,maxy")
    q.add_argument("--n-queries", type=int, default=200)
    q.add_argument("--seed", type=int, default=42)
    q.add_argument("--out", required=True)
    e = sub.add_parser("evaluate", help="search and evaluate queries with known positions")
    e.add_argument("--queries", required=True, help="Parquet of (query_id, v, gt_x, gt_y)")
    f = sub.add_parser("flight", help="search and evaluate the frames of a flight")
    f.add_argument("--frames", required=True, help="Parquet of (filename, v)")
    f.add_argument("--gt-csv", help="positions of the frames; without the file those in the images count")
    f.add_argument("--images", help="folder of the images")
    for x in (e, f):
        x.add_argument("--index", required=True)
        x.add_argument("--strategy", default="cls")
        x.add_argument("--top-pages", type=int, default=5)
        x.add_argument("--top-k", type=int, default=10)
        x.add_argument("--tolerance-m", type=float, default=30.0)
        x.add_argument("--out", required=True)
    d = sub.add_parser("descriptors", help="patch tokens to one embedding a tile")
    d.add_argument("--tokens", required=True, help="Parquet of (image_id, token_idx, v)")
    d.add_argument("--strategy", choices=pooling.STRATEGIES, default="cls")
    d.add_argument("--registers", type=int, default=4)
    d.add_argument("--grid", type=int, nargs=2, default=(4, 4), help="rows and columns of patches")
    d.add_argument("--bins", type=int, default=8)
    d.add_argument("--dim", type=int, default=64)
    d.add_argument("--out", required=True)
    b = sub.add_parser("ablation", help="compare strategies by their candidates")
    b.add_argument("--truth", required=True, help="Parquet of (query_id, gt_x, gt_y)")
    b.add_argument("--candidates", required=True, help="Parquet of (strategy, query_id, rank, center_x, center_y)")
    b.add_argument("--base", default="cls", help="strategy whose index the multi-rotation search uses")
    b.add_argument("--tolerance-m", type=float, default=30.0)
    b.add_argument("--out", required=True)
    t = sub.add_parser("telemetry", help="follow a folder of telemetry lines and append parsed rows")
    t.add_argument("--lines", required=True, help="folder of text files")
    t.add_argument("--max-seconds", type=float, help="end after that time and the last batch")
    t.add_argument("--checkpoint", required=True)
    t.add_argument("--out", required=True)
    return p


def _evaluate(spark: SparkSession, a: argparse.Namespace, queries: DataFrame, key: str, **settings: object) -> None:
    """Candidates, a row for each query and the summary of queries (query_id, v, gt_x, gt_y)."""
    found = writers.read_index(spark, a.index)
    ranked = retrieval.search(queries.select("query_id", "v"), found.tiles, found.coarse, a.top_pages, a.top_k)
    writers.write_candidates(ranked, f"{a.out}/candidates")
    ranked = spark.read.parquet(f"{a.out}/candidates")
    truth = queries.select("query_id", "gt_x", "gt_y")
    result = evaluate.evaluate_retrieval(truth, evaluate.located(ranked, found.tiles), tolerance_m=a.tolerance_m)
    writers.write_report(evaluate.per_query(truth, ranked).withColumnRenamed("query_id", key), f"{a.out}/per_query", [key])
    writers.write_lines(evaluate.summary(result, a.strategy, a.tolerance_m, **settings), "value", f"{a.out}/summary")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tilequarry {a.command}").getOrCreate()
    if a.command == "catalog":
        left, top, gsd, width, height = a.raster
        points = readers.read_points(spark, a.points)
        points = points.withColumn(a.order, F.col(a.order).cast("long")) if a.order == "tile_id" and "tile_id" in points.columns else points
        order = a.order if a.order in points.columns else points.columns[0]
        writers.write_catalog(catalog.build_catalog(points, Raster(left, top, gsd, int(width), int(height)), a.tile_px, a.stride_px, a.page_size_m, [order], a.config_name), a.out)
    elif a.command == "index":
        writers.write_index(index.build_index(readers.read_catalog(spark, a.catalog), spark.read.parquet(a.embeddings)), a.out)
        writers.write_json(spark, {"catalog": a.catalog, "embeddings": a.embeddings}, f"{a.out}/manifest")
    elif a.command == "queries":
        if len(a.box) != 4:
            raise SystemExit("--box takes four numbers")
        made = synthetic.synthetic_queries(spark, tuple(a.box), synthetic.SyntheticConfig(n_queries=a.n_queries, seed=a.seed))
        writers.write_report(made, a.out, ["query_index"])
    elif a.command == "evaluate":
        _evaluate(spark, a, spark.read.parquet(a.queries), "query_id", top_pages=a.top_pages, top_k=a.top_k)
    elif a.command == "flight":
        frames = spark.read.parquet(a.frames).select("filename", "v").join(readers.read_flight(spark, a.gt_csv, a.images), "filename")
        _evaluate(spark, a, frames.withColumnRenamed("filename", "query_id"), "filename")
    elif a.command == "descriptors":
        made = pooling.descriptor(spark.read.parquet(a.tokens), a.strategy, a.registers, tuple(a.grid), a.bins, a.dim)
        made.select(F.col("image_id").cast("long").alias("tile_id"), F.col("v").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(f"{a.out}/embeddings")
        writers.write_json(spark, {"tokens": a.tokens, "strategy": a.strategy, "registers": a.registers, "grid": list(a.grid), "bins": a.bins, "dim": a.dim}, f"{a.out}/manifest")
    elif a.command == "ablation":
        table = ablation.ablation_table(spark.read.parquet(a.truth), spark.read.parquet(a.candidates), a.tolerance_m, a.base)
        writers.write_report(table, f"{a.out}/table", ["strategy"])
        digits = {"median_error_m": 3, "mean_error_m": 3} | {f"recall_at_{k}": 4 for k in evaluate.K_VALUES}
        writers.write_lines(ablation.markdown(table, digits).orderBy("strategy"), "line", f"{a.out}/markdown")
    else:
        telemetry.log(telemetry.read_lines(spark, a.lines), a.out, a.checkpoint, a.max_seconds).awaitTermination()


if __name__ == "__main__":
    main()
