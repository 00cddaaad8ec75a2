"""Projects as rows, and sinks of samples and pixels."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = """items array<struct<id: bigint, type: string, source: string, x: bigint, y: double, length: bigint, height: double, offset: bigint,
anchors: array<struct<target: bigint, offset_ns: bigint, visible: boolean, two_way: boolean>>>>"""


def load_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A project file (JSON, items with anchors by item id) as clip and anchor tables.

    An item's place in its list is its z; a lower one is in front. Values that aren't given have their defaults."""
    items = spark.read.schema(PROJECT).json(path, multiLine=True).select(F.posexplode("items").alias("z", "i"))
    given = lambda c, v: F.coalesce(c, F.lit(v))
    own = lambda c, v: given(F.col(f"i.{c}"), v).alias(c)
    clip = items.select(F.col("i.id").alias("item_id"), own("type", "video"), F.col("i.source").alias("source_id"), own("x", 0), own("y", 0.0), own("length", 1), own("height", 1.0), own("offset", 0), "z")
    a = items.select(F.col("i.id").alias("source"), F.explode("i.anchors").alias("a"))
    flags = [given(F.col(f"a.{c}"), False).alias(c) for c in ("visible", "two_way")]
    return {"clip": clip, "anchor": a.select("source", "a.target", given(F.col("a.offset_ns"), 0).alias("offset_ns"), *flags)}


ASSET = "project string, asset string, kind string, plugin string, definition string"
ITEM = "project string, asset string, item_id bigint, kind string, type string, source_asset string, source_stream string, x bigint, y double, length bigint, height double, offset bigint, z bigint"
PART = "project string, asset string, item_id bigint, idx bigint, source_asset string, source_stream string, offset bigint, length bigint, transition_length bigint"
ANCHOR = "project string, asset string, source bigint, target bigint, offset_ns bigint, visible boolean, two_way boolean"
TABLES = {"asset": ASSET, "item": ITEM, "sequence_item": PART, "anchor": ANCHOR}


def _tagged(text: str) -> dict:
    """A project file's values; what has a tag is a dict of its own kind, and what it names twice is one and the same."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):  # libyaml's parser where it is there
        pass

    def build(loader, tag, node):
        if isinstance(node, yaml.MappingNode):
            out = {"_tag": tag}
            yield out  # before its values are made, as they may name it again
            out.update(loader.construct_mapping(node, deep=True))
        elif isinstance(node, yaml.SequenceNode):
            yield {"_tag": tag, "values": loader.construct_sequence(node, deep=True)}
        else:
            yield {"_tag": tag, "text": loader.construct_scalar(node)}

    Loader.add_multi_constructor("!", build)
    return yaml.load(text, Loader) or {}


def _rows(name: str, project: dict) -> dict[str, list[tuple]]:
    """Rows of TABLES of one project. Links are put right: an item's place in its list is its number and its z, and an anchor
    names its target by that number; one whose target is not in its space is an error."""
    import json as js

    out: dict[str, list[tuple]] = {k: [] for k in TABLES}
    source = lambda i: ((i.get("source") or {}).get("asset_path"), (i.get("source") or {}).get("stream"))
    for asset, a in (project.get("assets") or {}).items():
        asset = str(asset)
        out["asset"].append((name, asset, a.get("_tag"), a.get("plugin_urn"), js.dumps(a["definition"], sort_keys=True) if "definition" in a else None))
        items = (a.get("space") or {}).get("items") or []
        number = {id(i): k for k, i in enumerate(items)}
        for k, i in enumerate(items):
            parts = i.get("items") or []
            size = sum(p["length"] for p in parts) - sum(p.get("transition_length", 0) for p in parts[1:]) if parts else i.get("length", 1)
            out["item"].append((name, asset, k, i.get("_tag"), i.get("type", "video"), *source(i), i.get("x", 0), float(i.get("y", 0)), size, float(i.get("height", 1)), i.get("offset", 0), k))
            out["sequence_item"] += [(name, asset, k, n, *source(p), p.get("offset", 0), p["length"], p.get("transition_length", 0)) for n, p in enumerate(parts)]
            if anchor := i.get("anchor"):
                if id(anchor.get("target")) not in number:
                    raise ValueError(f"{name}: an anchor's target is not in its space")
                out["anchor"].append((name, asset, k, number[id(anchor["target"])], anchor.get("offset_ns", 0), bool(anchor.get("visible", False)), bool(anchor.get("two_way", False))))
    return out


def load_projects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """YAML project files (a file, a folder or a pattern) as tables of assets, items, sequences' items and anchors.

    A file is a task's row; files are read and parsed where Spark deals them to. PyYAML has to be installed there."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))

    def table(what: str) -> DataFrame:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in TABLES[what].split(", ")])

        def run(batches):
            for b in batches:
                for name, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if rows := _rows(name, _tagged(text))[what]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        return files.mapInArrow(run, TABLES[what])

    return {k: table(k) for k in TABLES}


def dump_project(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON text for each clip, without the values that are defaults."""
    drop = lambda c, v: F.when(F.col(c) != v, F.col(c)).alias(c)
    a = tables["anchor"].groupBy(F.col("source").alias("item_id")).agg(F.sort_array(F.collect_list(F.struct("target", "offset_ns", "two_way"))).alias("anchors"))
    c = tables["clip"].join(a, "item_id", "left")
    return c.select("item_id", F.to_json(F.struct("type", "source_id", drop("x", 0), drop("y", 0.0), "length", drop("offset", 0), "anchors")).alias("json"))


def pull(df: DataFrame) -> int:
    """Run a plan for its time alone: the nanoseconds that it takes."""
    t = time.perf_counter_ns()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter_ns() - t
