"""Keyed stores as tables: labels, embeddings and images by key, sample rows, availability, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.operators.stats import first_per_key


def label_store(rows: DataFrame, names: list[str], *, key: str = "accession", order: tuple[str, ...] = ("shard", "row"), fingerprint: str | None = None) -> DataFrame:
    """(key, labels, masks): the first row of each key; an error if widths or the order of concepts differ."""
    if fingerprint is not None:
        own = rows.sparkSession.range(1).select(N.fingerprint(F.array(*map(F.lit, names))).alias("x")).first()["x"]
        if own != fingerprint:
            raise ValueError("the store was written for other concepts, or another order")
    k = len(names)
    checked = rows.withColumn("labels", F.when((F.size("labels") == k) & (F.size("masks") == k), F.col("labels")).otherwise(F.raise_error(F.concat(F.lit("wrong width at "), F.col(key).cast("string"))).cast("array<float>")))
    return first_per_key(checked.select(key, *order, "labels", "masks"), [key], list(order)).select(key, "labels", "masks")


def embedding_store(units: DataFrame, fields: list[str], *, key: str = "accession", order: tuple[str, ...] = ("shard", "row")) -> DataFrame:
    """(key, field, vector): wanted fields only, the first row of each (key, field)."""
    rows = units.where(F.col("field").isin(fields)).select(key, "field", *order, "vector")
    return first_per_key(rows, [key, "field"], list(order)).select(key, "field", "vector")


def image_store(images: DataFrame, wanted: DataFrame, key: str = "sop_uid") -> DataFrame:
    """Images of the wanted keys; an error names a key without one."""
    both = wanted.select(key).distinct().join(images.withColumn("_here", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no image for "), F.col(key).cast("string"))).cast("boolean")
    return both.where(F.coalesce("_here", missing)).drop("_here")


def field_map(units: DataFrame, key: str = "accession") -> DataFrame:
    """(key, vectors): a map from field to vector."""
    return units.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "vector")))).alias("vectors"))


def paths(rows: DataFrame, root: str, listing: DataFrame, *, name: str = "sop_uid", suffix: str = ".npy") -> DataFrame:
    """rows with `path` and has_file, by a join with a listing (path)."""
    made = rows.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), F.col(name).cast("string"), F.lit(suffix)))
    return made.join(listing.select("path").distinct().withColumn("_here", F.lit(True)), "path", "left").withColumn("has_file", F.coalesce("_here", F.lit(False))).drop("_here")


def resolved(rows: DataFrame, candidates: list, listing: DataFrame, key: str) -> DataFrame:
    """(key, path): the first candidate expression that the listing has; rows without one go."""
    each = rows.select(key, F.posexplode(F.array(*candidates)).alias("turn", "path"))
    return each.join(listing.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.min_by("path", "turn").alias("path"))


def samples(index: DataFrame, images: DataFrame, texts: DataFrame, labels: DataFrame, override: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """One row per image: pixels, vectors by field, labels and masks; an override of labels comes first.

    strict: an error for an accession without labels.
    """
    rows = index.join(images, "sop_uid").join(texts, "accession", "left").join(labels, "accession", "left")
    if override is not None:
        other = override.select("accession", F.col("labels").alias("_labels"), F.col("masks").alias("_masks"))
        rows = rows.join(other, "accession", "left").withColumn("labels", F.coalesce("_labels", "labels")).withColumn("masks", F.coalesce("_masks", "masks")).drop("_labels", "_masks")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no labels for "), F.col("accession").cast("string"))).cast("boolean")
        rows = rows.where(F.when(F.col("labels").isNotNull(), True).otherwise(missing))
    return rows


def required(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows with all flags."""
    for f in flags:
        rows = rows.where(F.col(f))
    return rows


def split_or_all(rows: DataFrame, split: str) -> DataFrame:
    """Rows of the split; all rows where the table has none of it."""
    have = rows.where(F.col("split") == split).select(F.lit(True).alias("_have")).limit(1)
    return rows.join(F.broadcast(have), how="left").where((F.col("split") == split) | F.col("_have").isNull()).drop("_have")


def last_in_shard(rows: DataFrame, shard: str, row: str, key: str) -> DataFrame:
    return rows.groupBy(shard).agg(F.max_by(key, row).alias("last_key"), F.count("*").alias("n_rows"))


def complete_shards(kinds: list[DataFrame]) -> DataFrame:
    """Shard numbers that every kind of file has."""
    out = kinds[0].select("shard")
    for k in kinds[1:]:
        out = out.intersect(k.select("shard"))
    return out


def run_summary(rows: DataFrame) -> DataFrame:
    """Counters of a label run, of rows (has_json, error, n_valid, n_imputed)."""
    return rows.agg(F.count("*").alias("n_reports"), F.count_if("has_json").alias("n_with_json"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"), F.sum("n_valid").alias("n_valid"), F.count_if(F.col("n_imputed") > 0).alias("n_reports_imputed"), F.sum("n_imputed").alias("n_imputed"))


def seeds(rows: DataFrame, values: list[int]) -> DataFrame:
    """rows once for each seed."""
    return rows.withColumn("seed", F.explode(F.array(*map(F.lit, values))))


#: What a sharded store of a kind holds beside its meta files.
_PARTS = {"images": ("images",), "embeddings": ("embeddings",), "labels": ("labels", "masks")}


def layout(listing: DataFrame, kind: str, mode: str = "auto") -> str:
    """sharded (meta_*.parquet and the kind's *.npy) or pt, of a listing (path); images in neither are an error, others count as pt."""
    if mode != "auto":
        return mode
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    seen = listing.agg(*(F.coalesce(F.max(name.rlike(p)), F.lit(False)).alias(f"c{i}") for i, p in enumerate([r"^meta_.*\.parquet$", r"\.pt$", *(rf"^{k}_.*\.npy$" for k in _PARTS[kind])]))).first()
    if seen[0] and all(seen[2:]):
        return "sharded"
    if kind == "images" and not seen[1]:
        raise FileNotFoundError("neither image shards nor .pt files")
    return "pt"


def attention_of(maps: DataFrame, concept: str) -> DataFrame:
    """(split, sample_id, height, width, grid) of saved maps (split, sample_id, names, height, width, values): one concept's; an error where it is not named."""
    at = F.array_position("names", F.lit(concept))
    size = F.col("height") * F.col("width")
    lost = F.raise_error(F.concat(F.lit(f"no map of {concept} for "), F.col("sample_id").cast("string"))).cast("array<float>")
    grid = F.when(at > 0, F.slice("values", ((at - 1) * size + 1).cast("int"), size)).otherwise(lost)
    return maps.select("split", "sample_id", "height", "width", grid.alias("grid"))


def resumed_after(rows: DataFrame, written: DataFrame, shard_rows: int, key: str, order: list) -> tuple[DataFrame, int]:
    """(rows still to write, number of the next shard): written (shard, key) up to its last whole shard counts, the rest is written again.

    A shard is whole with `shard_rows` rows, if all before it are.
    """
    counts = {r["shard"]: r["n"] for r in written.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    n = 0
    while counts.get(n) == shard_rows:
        n += 1
    done = written.where(F.col("shard") < n).select(key).distinct()
    return rows.join(done, key, "left_anti").orderBy(*order), n
