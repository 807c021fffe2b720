"""Vector retrieval against banks, pooling, zero-shot scores, evidence tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import documents as D
from loomwork.functions import numeric as N
from loomwork.session import small, stored


#: Bytes of a tile of queries, and of a tile of a bank: what one task multiplies at a time.
TILE_BYTES = 8 << 20


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    cells = table.column(column).combine_chunks()
    cells = pa.concat_arrays(cells.chunks) if isinstance(cells, pa.ChunkedArray) else cells
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1)


def _nearest(queries: pa.Table, bank: pa.Table, k: int) -> pa.Table:
    """Of a tile of a concept's bank: each query's k most similar different texts, told apart by their codes."""
    kinds = [("query_id", pa.int64()), ("concept", bank.schema.field("concept").type), ("text", pa.string()), ("code", pa.binary()), ("text_idx", pa.int64()), ("sim", pa.float64())]
    whose, at, sim = [], [], []
    if queries.num_rows and bank.num_rows:
        u, ids = _matrix(bank, "u"), bank.column("text_idx").to_numpy()
        codes = np.frombuffer(b"".join(bank.column("code").to_pylist()), "<u8").reshape(-1, 2)
        group = np.empty(len(codes), np.int64)
        order = np.lexsort((codes[:, 1], codes[:, 0]))
        group[order] = np.cumsum(np.concatenate(([0], (codes[order][1:] != codes[order][:-1]).any(1))))
        v, q_ids = _matrix(queries, "v"), queries.column("q_id").to_numpy()
        for a in range(0, len(v), 256):
            for q, s in zip(q_ids[a : a + 256], v[a : a + 256] @ u.T, strict=True):
                order = np.lexsort((ids, -s))
                _, first = np.unique(group[order], return_index=True)
                best = order[np.sort(first)[:k]]
                whose.append(np.full(len(best), q))
                at.append(best)
                sim.append(s[best])
    at = np.concatenate(at) if at else np.empty(0, np.int64)
    picked = bank.take(pa.array(at))
    return pa.table([pa.array(np.concatenate(whose) if whose else [], pa.int64()), picked.column("concept"), picked.column("text"), picked.column("code"), picked.column("text_idx").cast(pa.int64()), pa.array(np.concatenate(sim) if sim else [], pa.float64())], pa.schema(kinds))


def tiled(queries: DataFrame, bank: DataFrame, tile: int = TILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into tiles of about `tile` bytes: queries (concept, q_tile, b_tile, q_id, v), bank (concept, q_tile, b_tile, text_idx, text, code, u).

    The tiles of a concept are numbered by its bytes on each side, which are summed
    first; each tile of queries is sent to each tile of its concept's bank, so a row is
    copied as often as the *other* side has tiles, whatever the number of partitions.
    """
    q = queries.select(F.col("query_id").cast("long").alias("q_id"), "concept", N.unit("v").alias("v")).where(F.col("concept").isNotNull())
    b = bank.select("concept", F.col("text_idx").cast("long").alias("text_idx"), F.trim("text").alias("text"), N.unit("raw").alias("u")).where(F.col("concept").isNotNull() & F.col("text").isNotNull())
    code = F.unhex(F.md5(F.col("text").cast("binary")))
    b = b.withColumn("code", code)
    n = lambda rows, size, name: rows.groupBy("concept").agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / tile)).cast("int").alias(name))
    counts = n(q, 8 * F.size("v") + 32, "q_tiles").join(n(b, 8 * F.size("u") + F.octet_length("text") + 64, "b_tiles"), "concept")
    counts = small(stored(counts, "tiles"))
    of = lambda key, tiles: F.pmod(F.xxhash64(*key), F.col(tiles)).cast("int")
    each = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    q = q.join(counts, "concept").withColumn("q_tile", of(["q_id"], "q_tiles")).withColumn("b_tile", each("b_tiles"))
    b = b.join(counts, "concept").withColumn("b_tile", of(["text_idx", "text"], "b_tiles")).withColumn("q_tile", each("q_tiles"))
    return q.select("concept", "q_tile", "b_tile", "q_id", "v"), b.select("concept", "q_tile", "b_tile", "text_idx", "text", "code", "u")


def top_texts(queries: DataFrame, bank: DataFrame, k: int = 5, tile: int = TILE_BYTES) -> DataFrame:
    """(query_id, concept, rank, sim, text): the k most similar different texts of the query's concept.

    queries (query_id, concept, v), bank (concept, text_idx, text, raw): both are
    normalised; of equal texts the most similar counts, the smallest text_idx on ties; rows
    without a concept or a text take no part.  Tiles of both sides are multiplied in Arrow;
    a tile returns at most k rows a query, and these are merged by the texts' codes.
    """
    q, b = tiled(queries, bank, tile)
    kind = bank.schema["concept"].dataType.simpleString()
    cells = ["concept", "q_tile", "b_tile"]
    best = q.groupBy(*cells).cogroup(b.groupBy(*cells)).applyInArrow(lambda x, y: _nearest(x, y, k), f"query_id long, concept {kind}, text string, code binary, text_idx long, sim double")
    one = best.groupBy("query_id", "concept", "code").agg(F.min(F.struct((-F.col("sim")).alias("far"), "text_idx", "text")).alias("m"))
    rank = F.row_number().over(W.partitionBy("query_id", "concept").orderBy("m.far", "m.text_idx"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "concept", "rank", (-F.col("m.far")).alias("sim"), "m.text")


def pooled(rows: DataFrame, key: list[str], vector: str, how: str = "mean", normalise: bool = True) -> DataFrame:
    """One vector for each key: component-wise mean or maximum, then of length 1."""
    agg = {"mean": F.avg, "max": F.max}[how]
    each = rows.select(*key, F.posexplode(vector).alias("pos", "x"))
    per = each.groupBy(*key, "pos").agg(agg(F.col("x").cast("double")).alias("x"))
    out = per.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("pooled"))
    return out.withColumn("pooled", N.unit("pooled")) if normalise else out


def zero_shot(queries: DataFrame, prompts: DataFrame, *, temperature: float = 0.07, how: str = "mean") -> DataFrame:
    """(query_id, concept, prob): sigmoid of the difference to positive and negative prompt banks (concept, positive, raw)."""
    banks = pooled(prompts.withColumn("raw", N.unit("raw")), ["concept", "positive"], "raw", how)
    both = banks.groupBy("concept").agg(F.max_by("pooled", F.when(F.col("positive"), 1)).alias("pos"), F.max_by("pooled", F.when(~F.col("positive"), 1)).alias("neg"))
    q = queries.withColumn("v", N.unit("v"))
    return q.join(both, "concept").select("query_id", "concept", N.sigmoid(N.dot("v", "pos") - N.dot("v", "neg"), temperature).alias("prob"))


def projected(rows: DataFrame, vector: str, weights: list[list[float]], bias: list[float] | None = None) -> DataFrame:
    """rows with `vector` multiplied by a matrix (rows of weights), plus bias."""
    bias = bias or [0.0] * len(weights)
    out = F.array(*(N.dot(F.col(vector), F.array(*map(F.lit, w))) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)))
    return rows.withColumn(vector, out)


def dense(rows: DataFrame, concepts: DataFrame, width: int, report: str = "report_id") -> DataFrame:
    """(report, matrix, mask): a row of K vectors in concept order, zeros and false where absent or of another width."""
    keys = rows.select(report).distinct().crossJoin(F.broadcast(concepts.select("idx", "name")))
    full = keys.join(rows.select(report, "name", "vector"), [report, "name"], "left")
    ok = F.coalesce(F.size("vector") == width, F.lit(False))
    cell = F.struct("idx", F.when(ok, F.col("vector").cast("array<float>")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), width)).alias("v"), ok.alias("ok"))
    out = full.groupBy(report).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return out.select(report, F.transform("cells", lambda c: c["v"]).alias("matrix"), F.transform("cells", lambda c: c["ok"]).alias("mask"))


def head_map(names: list[str], wanted: list[str]) -> list[int]:
    """Positions of wanted names; an error names the missing ones."""
    at = {n: i for i, n in enumerate(names)}
    if missing := [w for w in wanted if w not in at]:
        raise ValueError(f"unknown concepts: {missing}")
    return [at[w] for w in wanted]


def hash_vectors(texts: DataFrame, text: str = "text", width: int = 64) -> DataFrame:
    """texts with a `vector` of length 1, drawn from a generator seeded by the text's sha1: a stand-in for an encoder."""
    from pyspark.sql.types import ArrayType, FloatType, StructType

    schema = StructType([*texts.schema.fields]).add("vector", ArrayType(FloatType()))

    def run(batches):
        import hashlib

        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                v = np.random.default_rng(int.from_bytes(hashlib.sha1((t or "").encode()).digest()[:8], "big")).standard_normal(width)
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], [*b.schema.names, "vector"])

    return texts.mapInArrow(run, schema)


#: A token, where a text is cut without a tokenizer of its own.
TOKEN = r"[^\x20\x09-\x0D]+"


def windows(texts: DataFrame, *, text: str = "text", size: int = 512, overlap: int = 64, tokens: Column | None = None) -> DataFrame:
    """texts with window, start, n_tokens, n_windows, window_text: runs of `size` tokens, each sharing `overlap` with the one before.

    A text of at most `size` tokens is one window; the last window ends with the text, so
    no token is lost; texts without tokens (null too) have no window.  tokens: an array of
    strings, by default the text's words; windows are joined by blanks.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step = size - overlap
    rows = texts.withColumn("_t", F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)) if tokens is None else tokens)
    n = F.coalesce(F.size("_t"), F.lit(0))
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(float(step)))).cast("int")
    rows = rows.withColumn("n_windows", count).where("n_windows > 0").withColumn("window", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)))
    rows = rows.withColumn("start", F.col("window") * step).withColumn("_t", F.slice("_t", F.col("window") * step + 1, size))
    return rows.withColumn("n_tokens", F.size("_t")).withColumn("window_text", F.array_join("_t", " ")).drop("_t")


def long_texts(texts: DataFrame, key: list[str], **options) -> DataFrame:
    """(key.., n_windows) of texts that are cut: what a log of long texts says."""
    return windows(texts, **options).where("window = 0 and n_windows > 1").select(*key, "n_windows")


def window_means(texts: DataFrame, key: list[str], encode: Callable[[DataFrame], DataFrame], width: int, *, weighted: bool = False, normalise: bool = True, **options) -> DataFrame:
    """(key.., n_windows, n_tokens, vector): windows of each text encoded apart, each of length 1, and their mean, of length 1 again.

    encode: rows with `window_text` -> the same rows with `vector`.  weighted: a
    window counts by its tokens, else all alike.  Texts without tokens have zeros.  The
    windows are encoded as rows of their own, so a long text is dealt over as many
    tasks as its windows are; one row of a text holds its windows' vectors.
    """
    rows = encode(windows(texts, **options).select(*key, "window", "n_windows", "n_tokens", "window_text"))
    vector = N.unit("vector", 1e-8, True) if normalise else F.transform("vector", lambda x: x.cast("double"))
    cells = rows.groupBy(*key, "n_windows").agg(F.array_sort(F.collect_list(F.struct("window", "n_tokens", vector.alias("v")))).alias("c"))
    weight = lambda x: x["n_tokens"].cast("double") if weighted else F.lit(1.0)
    zeros = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate("c", zeros, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b * weight(x)))
    mass = F.aggregate("c", F.lit(0.0), lambda s, x: s + weight(x))
    tokens = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["n_tokens"])
    means = cells.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("n_windows").alias("_w"), tokens.alias("_n"), F.transform(total, lambda x: x / mass).alias("_v"))
    if normalise:
        means = means.withColumn("_v", N.unit("_v"))
    out = texts.select(*key).join(means, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    return out.select(*key, F.coalesce("_w", F.lit(0)).alias("n_windows"), F.coalesce("_n", F.lit(0)).alias("n_tokens"), F.coalesce("_v", zeros).alias("vector"))


def best_match(matches: DataFrame, rank: int = 1) -> DataFrame:
    """The match of each concept: the asked rank if there is one, else by rank (none last), similarity, file order."""
    order = [(F.col("rank") != rank) | F.col("rank").isNull(), F.col("rank").asc_nulls_last(), F.coalesce("sim", F.lit(-1.0)).desc(), "ord"]
    turn = F.row_number().over(W.partitionBy("case_id", "concept").orderBy(*order))
    return matches.withColumn("turn", turn).where("turn = 1").drop("turn")


def device_word(concept, positive) -> Column:
    device = F.startswith(concept, F.lit("support_devices."))
    return F.when(device & positive, "present").when(device, "not present").when(positive, "pathological").otherwise("not pathological")


def evidence(predictions: DataFrame, thresholds: DataFrame, matches: DataFrame, *, key: str = "thr_f1", fallback: tuple[str, ...] = ("thr_j",), default: float = 0.5) -> DataFrame:
    """(case_id, concept, probability, threshold, threshold_source, predicted, label, text, sim).

    The threshold is the first of key and fallbacks that the concept has, else the
    default.
    """
    names = (key, *fallback)
    t = thresholds.select("concept", F.coalesce(*(F.nanvl(n, F.lit(None).cast("double")) for n in names)).alias("thr"), F.coalesce(*(F.when(F.nanvl(n, F.lit(None).cast("double")).isNotNull(), n) for n in names)).alias("src"))
    rows = predictions.join(t, "concept", "left").join(best_match(matches).select("case_id", "concept", "text", "sim"), ["case_id", "concept"], "left")
    thr = F.coalesce("thr", F.lit(default))
    yes = F.col("probability") >= thr
    return rows.select("case_id", "concept", "probability", thr.alias("threshold"), F.coalesce("src", F.lit("default")).alias("threshold_source"), yes.cast("int").alias("predicted"), device_word(F.col("concept"), yes).alias("label"), F.coalesce("text", F.lit("")).alias("text"), "sim")


def payload(rows: DataFrame, paths: list[str]) -> DataFrame:
    """(case_id, payload): a nested JSON object with each path's label and text."""
    at = lambda p, c: F.max(F.when(F.col("concept") == p, F.col(c)))
    cells = rows.groupBy("case_id").agg(*(at(p, c).alias(f"{c}{i}") for i, p in enumerate(paths) for c in ("label", "text")))
    value = {p: F.struct(F.coalesce(f"label{i}", F.lit("")).alias("label"), F.coalesce(f"text{i}", F.lit("")).alias("text")) for i, p in enumerate(paths)}
    return cells.select("case_id", D.nested(value).alias("payload"))


def feedback(answers: DataFrame) -> DataFrame:
    """(case_id, status, text): inconsistent if any part is, else unclear if any, else consistent; comments in order of path."""
    has = lambda s: F.max(F.when(F.col("status") == s, 1).otherwise(0)) == 1
    said = F.when((F.col("status") != "consistent") & (F.coalesce("comment", F.lit("")) != ""), F.struct("path", F.concat("path", F.lit(": "), "comment").alias("t")))
    return answers.groupBy("case_id").agg(F.when(has("inconsistent"), "inconsistent").when(has("unclear"), "unclear").otherwise("consistent").alias("status"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["t"]), "\n").alias("text"))


def conversation(turns: DataFrame, system: str | None = None) -> DataFrame:
    """(conv_id, messages): an array of role and content in order of turn."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    if system is not None:
        m = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), m)
    return turns.groupBy("conv_id").agg(m.alias("messages"))
