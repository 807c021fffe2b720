"""Binary labels with masks, context-dependent imputation, quotas, vectors.

Long form inside: one row per (report, concept); vectors only at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import numeric as N
from loomwork.operators import ranks

PATHOLOGY = ("pathologies.lung.", "pathologies.pleura.", "pathologies.vessels.", "pathologies.bones.")


def label_and_mask(value, number: Column | None = None) -> tuple[Column, Column]:
    """(label, valid) of a label: present 1, not present 0, 1 -> 0, 2 and 3 -> 1; 0, others and null masked.

    value is a string, of which only the two words and plain digits say anything ("2.0" and
    "true" don't); number: the value where it was a JSON number or boolean instead.
    """
    word = F.lower(F.trim(value))
    n = F.when(F.regexp_like(word, F.lit("^[0-9]{1,9}$")), word.try_cast("int")).cast("double")
    if number is not None:
        n = F.coalesce(number.cast("double"), n)
    label = F.when((word == "present") | n.isin(2.0, 3.0), 1).otherwise(0)
    valid = F.coalesce((word == "present") | (word == "not present") | n.isin(1.0, 2.0, 3.0), F.lit(False))
    return label, valid


def json_label(doc) -> tuple[Column, Column]:
    """(label, valid) of a label as JSON text, by its JSON type: an object counts by its own `label`."""
    whole = F.try_parse_json(doc)
    inner = F.try_variant_get(whole, "$.label", "variant")
    node = F.when(F.schema_of_variant(whole).startswith("OBJECT") & inner.isNotNull(), inner).otherwise(whole)
    kind = F.schema_of_variant(node)
    word = F.when(kind == "STRING", F.try_variant_get(node, "$", "string"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(node, "$", "boolean").cast("double")).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(node, "$", "double"))
    return label_and_mask(word, number)


def labelled(rows: DataFrame, value: str = "value") -> DataFrame:
    label, valid = label_and_mask(F.col(value))
    return rows.withColumn("label", label).withColumn("valid", valid)


def with_context(leaves: DataFrame, hit: Column, report: str = "doc_id") -> DataFrame:
    """leaves with n_other, and ratio: the percentage of a report's *other* leaves with `hit` (0 without others)."""
    per = W.partitionBy(report)
    own = F.coalesce(hit, F.lit(False)).cast("int")
    n = F.count(F.lit(1)).over(per) - 1
    return leaves.withColumn("n_other", n).withColumn("ratio", F.when(n > 0, (F.sum(own).over(per) - own) * 100.0 / n).otherwise(F.lit(0.0)))


def eligible_labels(leaves: DataFrame, *, least_other: int = 1, threshold: float = 70.0, value: str = "sev", report: str = "doc_id") -> DataFrame:
    """Pathology leaves with label 0 whose other leaves are non-zero often enough."""
    rows = with_context(leaves, F.col(value) != 0, report)
    return rows.where((F.col(value) == 0) & (F.col("n_other") >= least_other) & (F.col("ratio") >= threshold))


def quota_flags(rows: DataFrame, quotas: DataFrame, *, seed: int = 42, concept: str = "name", report: str = "doc_id", flag: str = "chosen", **limits) -> DataFrame:
    """rows with `flag`: whether they are of the quota rows of their concept with the smallest hashes of seed, report and concept.

    Each eligible row is as likely as any other, and reruns agree; a concept without a
    quota keeps none.  A concept's rows are never in one task: `ranks.smallest`.
    """
    code = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col(report).cast("string"), F.col(concept)).cast("binary"))
    return ranks.smallest(rows.withColumn("_code", code), concept, "_code", quotas.select(concept, "quota"), tie=report, flag=flag, **limits).drop("_code")


def within_quota(rows: DataFrame, quotas: DataFrame, *, seed: int = 42, concept: str = "name", report: str = "doc_id", **limits) -> DataFrame:
    """The rows that `quota_flags` chooses."""
    return quota_flags(rows, quotas, seed=seed, concept=concept, report=report, flag="_chosen", **limits).where("_chosen").drop("_chosen")


def vectors(rows: DataFrame, imputed: DataFrame | None = None, report: str = "doc_id", concept: str = "name") -> DataFrame:
    """rows (report, idx, concept, label, valid) -> labels, masks, n_valid, n_imputed, imputed_targets, one row per report."""
    if imputed is not None:
        rows = rows.join(imputed.select(report, concept).distinct().withColumn("chosen", F.lit(True)), [report, concept], "left")
    else:
        rows = rows.withColumn("chosen", F.lit(None).cast("boolean"))
    fill = F.coalesce(F.col("chosen") & ~F.col("valid"), F.lit(False))
    rows = rows.withColumn("fill", fill).withColumn("ok", F.col("valid") | fill).withColumn("y", F.when(fill | ~F.col("valid"), 0.0).otherwise(F.col("label").cast("double")))
    cells = F.array_sort(F.collect_list(F.struct("idx", "y", "ok", "fill", F.col(concept).alias("c"))))
    out = rows.groupBy(report).agg(cells.alias("cells"))
    return out.select(
        report, F.transform("cells", lambda x: x["y"].cast("float")).alias("labels"), F.transform("cells", lambda x: x["ok"]).alias("masks"),
        F.size(F.filter("cells", lambda x: x["ok"])).alias("n_valid"), F.size(F.filter("cells", lambda x: x["fill"])).alias("n_imputed"),
        F.array_join(F.transform(F.filter("cells", lambda x: x["fill"]), lambda x: x["c"]), "|").alias("imputed_targets"),
    )


def picked(column: str, order: list[int]) -> Column:
    """An array's elements in another order, or some of them."""
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.element_at(F.col(column), i + 1))


def eligible_devices(leaves: DataFrame, pools: DataFrame, *, prefix: str = "support_devices.") -> DataFrame:
    """Rule 1: device leaves with empty text, label `not present`, and a pool."""
    rows = leaves.where(F.startswith("name", F.lit(prefix)) & (F.coalesce("text", F.lit("")) == "") & (F.lower(F.trim("label")) == "not present"))
    return rows.join(F.broadcast(pools.where(F.size("pool") > 0)), "name")


def eligible_texts(leaves: DataFrame, pools: DataFrame, *, least_other: int = 1, threshold: float = 70.0, report: str = "doc_id") -> DataFrame:
    """Rule 2: pathology leaves with empty text and label 0 or 1 whose other leaves have text often enough, and a pool."""
    rows = with_context(leaves, F.coalesce("text", F.lit("")) != "", report)
    rows = rows.where((F.coalesce("text", F.lit("")) == "") & N.is_binary("label") & (F.col("n_other") >= least_other) & (F.col("ratio") >= threshold))
    return rows.join(F.broadcast(pools.where(F.size("pool") > 0)), "name")


def imputed_units(rows: DataFrame, seed: int = 42, rule: str = "rule1", report: str = "doc_id") -> DataFrame:
    """Units with a sentence picked from each row's pool, and where it came from."""
    return rows.select(report, F.concat(F.lit("structured."), "name").alias("field"), N.pick(F.col("pool"), seed, F.col(report).cast("string"), F.col("name")).alias("text"), F.lit("structured").alias("source"), F.lit(True).alias("is_imputed"), F.lit(rule).alias("imputation_rule"))


def units(reports: DataFrame, leaves: DataFrame, imputed: DataFrame | None = None, *, level: str = "both", groups: tuple[str, ...] = (), delimiter: str = " ; ", prefix: bool = False, skip: tuple[str, ...] = ("structured.comparison",), skip_prefixes: tuple[str, ...] = ("structured.report_date",), report: str = "doc_id") -> DataFrame:
    """All text units of each report: (report, ord, field, text, source, is_imputed).

    reports: (report, full); leaves: (report, at, name, text), `at` in document
    order; imputed: (report, at, name, text), `at` in its own order.  Full text,
    leaves, imputed leaves, grouped leaves, all structured text, and the whole
    report, in this order; empty and excluded ones go; of equal (field, text) the
    first stays.  A report's cells meet in one aggregation, and its units come from one
    explode, so sources are read once and shuffled once.
    """
    from loomwork.functions import text as T

    if level not in ("leaf", "full", "both"):
        raise ValueError(f"level: {level}")
    shape = lambda df, rank, at, name, text: df.select(report, F.struct(F.lit(rank).alias("rank"), at.cast("int").alias("at"), text.alias("text"), name.alias("name")).alias("cell"))
    rows = shape(reports, 1, F.lit(0), F.lit(""), F.col("full")).unionByName(shape(leaves.where("text <> ''"), 2, F.col("at"), F.col("name"), F.col("text")))
    if imputed is not None:
        rows = rows.unionByName(shape(imputed, 3, F.col("at"), F.col("name"), F.col("text")))
    cells = rows.groupBy(report).agg(F.array_sort(F.collect_list("cell")).alias("c"))
    unit = lambda rank, at, field, text, source, made: F.struct(F.struct(rank.alias("rank"), at.alias("at")).alias("ord"), field.alias("field"), text.alias("text"), F.lit(source).alias("source"), made.alias("is_imputed"))
    no, zero = F.lit(False), F.lit(0)
    excluded = lambda u: T.excluded(u["field"], skip, skip_prefixes)
    body = lambda x: T.prefixed(x["name"], x["text"], True) if prefix else x["text"]
    own = F.transform(F.filter("c", lambda x: x["rank"] > 1), lambda x: unit(x["rank"], x["at"], F.concat(F.lit("structured."), x["name"]), body(x), "structured", x["rank"] == 3))
    cells = cells.withColumn("kept", F.filter(own, lambda u: ~excluded(u)))
    joined = lambda found, by: F.array_join(F.transform(found, lambda x: x["text"]), by)
    parts = [F.col("kept")] if level != "full" else []
    for i, g in enumerate(groups):
        below = _below("c", g)
        parts.append(F.when(F.size(below) > 0, F.array(unit(F.lit(4), F.lit(i), F.lit(f"structured.grouped.{g}"), T.clean(joined(below, delimiter)), "grouped", no))))
    if level in ("full", "both"):
        whole = F.when(F.size("kept") > 0, joined("kept", " "))
        said = F.filter("c", lambda x: x["rank"] == 1)
        parts.append(F.transform(said, lambda x: unit(F.lit(1), zero, F.lit("unstructured.full"), T.clean(x["text"]), "unstructured", no)))
        parts.append(F.when(whole.isNotNull(), F.array(unit(F.lit(5), zero, F.lit("structured.full"), whole, "structured_full", no))))
        parts.append(F.transform(said, lambda x: unit(F.lit(6), zero, F.lit("report.full"), F.trim(F.concat_ws(" ", T.clean(x["text"]), whole)), "report_full", no)))
    none = F.filter("kept", lambda u: F.lit(False))
    each = cells.select(report, F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("u")).select(report, "u.ord", "u.field", "u.text", "u.source", "u.is_imputed")
    out = each.where((F.col("text") != "") & ~T.excluded(F.col("field"), skip, skip_prefixes))
    turn = F.row_number().over(W.partitionBy(report, "field", F.sha1(F.col("text").cast("binary"))).orderBy("ord"))
    return out.withColumn("turn", turn).where("turn = 1").drop("turn")


def _below(cells: str, group: str) -> Column:
    """Leaf cells of a group, or below it."""
    return F.filter(cells, lambda x: (x["rank"] > 1) & ((x["name"] == group) | F.startswith(x["name"], F.lit(group + "."))))


def inspection(leaves: DataFrame, *, least_other: int = 1, threshold: float = 70.0, report: str = "doc_id") -> DataFrame:
    """Per report and concept: raw label, label, base_valid, and the imputation decision with its numbers.

    leaves (report, name, label, sev); a decision is made for pathologies only, others
    have null there.
    """
    y, valid = label_and_mask(F.col("label"))
    rows = leaves.select(report, "name", F.col("label").alias("raw"), y.alias("label"), valid.alias("base_valid"))
    path = with_context(leaves.where(F.startswith("name", F.lit("pathologies."))), F.col("sev") != 0, report)
    ok = (F.col("sev") == 0) & (F.col("n_other") >= least_other) & (F.col("ratio") >= threshold)
    decided = path.select(report, "name", F.col("sev").alias("target_label"), "n_other", "ratio", ok.alias("eligible"))
    out = rows.join(decided, [report, "name"], "left")
    made = F.coalesce("eligible", F.lit(False)) & ~F.col("base_valid")
    return out.withColumn("imputed", made).withColumn("mask", F.col("base_valid") | made)
