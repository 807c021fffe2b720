"""Nested JSON documents: leaves, labels by path, validation, construction."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T

class Number(float):
    """A number that keeps how it was written."""

    __slots__ = ("written",)

    def __new__(cls, written: str):
        out = super().__new__(cls, written)
        out.written = written
        return out


class Nodes:
    """Table function: a JSON document -> (path, ord, value) of every node below the root, in document order."""

    def eval(self, doc: str):
        if doc is None:
            return
        try:
            root = json.loads(doc, parse_float=Number)
        except ValueError:
            return
        open_: list = [("", [], root)]
        while open_:
            path, order, node = open_.pop()
            if order:
                yield path, order, _written(node)
            if isinstance(node, dict):
                below = node.items()
            elif isinstance(node, list):
                below = ((f"[{i}]", x) for i, x in enumerate(node))
            else:
                continue
            cells = [(f"{path}.{key}" if path else key, [*order, i], x) for i, (key, x) in enumerate(below)]
            open_ += reversed(cells)


def _written(node) -> str | None:
    if node is None or isinstance(node, str):
        return node
    return node.written if isinstance(node, Number) else json.dumps(node, ensure_ascii=False)


def nodes(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Every node below the root: the columns of docs but `doc`, path, ord (document order), value (JSON text or plain).

    Objects give `a.b`, list items `a.[i]`, to any depth: a table function walks each
    document with a stack, beside its row (a lateral join), so a node is a row at once and no
    level is a pass or a column.  Null or malformed documents have no nodes; of a
    key that an object has twice the last counts; numbers are kept as written.
    """
    keep = [c for c in docs.columns if c != doc]
    walk = F.udtf(Nodes, returnType="path string, ord array<int>, value string")
    rows = docs.select(*(F.col(_quoted(c)).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(_quoted(doc)).cast("string").alias("_doc"))
    found = rows.lateralJoin(walk(F.col("_doc").outer()))
    return found.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "path", "ord", "value")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def labelled_leaves(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Nodes that are objects with a `text`: path, ord, text (cleaned), label (text form, null without)."""
    rows = nodes(docs, doc)
    has = F.array_contains(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), "text")
    rows = rows.where(F.startswith(F.ltrim("value"), F.lit("{")) & has)
    return rows.withColumn("text", T.clean(F.get_json_object("value", "$.text"))).withColumn("label", F.get_json_object("value", "$.label")).drop("value")


def text_leaves(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(path, ord, text) with non-empty text: objects' own text, and scalars anywhere but at keys text and label; a bare root is `_root`."""
    rows = nodes(docs, doc)
    keep = [c for c in docs.columns if c != doc]
    is_map, is_list = F.startswith(F.ltrim("value"), F.lit("{")), F.startswith(F.ltrim("value"), F.lit("["))
    inner = rows.where(~F.regexp_like("path", F.lit(r"(^|\.)(text|label)(\.|$)")))
    text = F.when(is_map, T.clean(F.get_json_object("value", "$.text"))).when(~is_list, T.clean("value"))
    leaves = inner.select(*keep, "path", "ord", text.alias("text")).where("text <> ''")
    bare = docs.select(*keep, F.lit("_root").alias("path"), F.array().cast("array<int>").alias("ord"), F.when(F.startswith(F.ltrim(doc), F.lit("{")), T.clean(F.get_json_object(doc, "$.text"))).when(~F.startswith(F.ltrim(doc), F.lit("[")), T.clean(doc)).alias("text"))
    return leaves.unionByName(bare.where("text <> ''"))


def json_path(path: str, base: str = "$") -> str:
    """The JSON path of a dotted one, its keys quoted: they may hold blanks and brackets."""
    return base + "".join(f"['{key}']" for key in path.split("."))


def at_path(doc, path: str) -> Column:
    """The value below `data` (or the root): a leaf object's label, else the value; null if absent."""
    def look(base: str) -> Column:
        whole = F.get_json_object(doc, json_path(path, base))
        return F.coalesce(F.get_json_object(doc, json_path(path, base) + ".label"), F.when(~F.startswith(F.ltrim(whole), F.lit("{")), whole))

    return F.coalesce(look("$.data"), look("$"))


def violations(docs: DataFrame, doc: str, kinds: dict[str, tuple]) -> DataFrame:
    """Rows (.., path, problem) of documents against {path: allowed labels}: missing, not allowed, extra leaf, malformed."""
    keep = [c for c in docs.columns if c != doc]
    bad = docs.where(F.try_parse_json(doc).isNull()).select(*keep, F.lit("").alias("path"), F.lit("malformed").alias("problem"))
    good = docs.where(F.try_parse_json(doc).isNotNull())
    spark = docs.sparkSession
    expected = spark.createDataFrame([(p, [str(v) for v in vs]) for p, vs in kinds.items()], "path string, allowed array<string>")
    found = labelled_leaves(good, doc).select(*keep, "path", F.coalesce("label", F.lit("")).alias("label"))
    want = good.select(*keep).crossJoin(F.broadcast(expected))
    both = want.join(found, [*keep, "path"], "full")
    problem = F.when(F.col("allowed").isNull(), "extra").when(F.col("label").isNull(), "missing").when(~F.array_contains("allowed", F.col("label")), "not allowed")
    return both.select(*keep, "path", problem.alias("problem")).where("problem is not null").unionByName(bad)


def nested(values: dict[str, Column]) -> Column:
    """A JSON object from {dotted path: value}."""
    tree: dict = {}
    for path, value in values.items():
        at = tree
        *inner, last = path.split(".")
        for key in inner:
            at = at.setdefault(key, {})
        at[last] = value

    def build(node):
        return F.struct(*(build(v).alias(k) for k, v in node.items())) if isinstance(node, dict) else node

    return F.to_json(build(tree))


def answer_schema(paths: list[str], final: bool = True) -> dict:
    """A strict JSON schema for an answer with a status and a comment at each path."""
    def leaf() -> dict:
        return _object({"status": {"type": "string", "enum": ["consistent", "inconsistent", "unclear"]}, "comment": {"type": "string"}})

    tree: dict = {}
    for path in paths:
        at = tree
        *inner, last = path.split(".")
        for key in inner:
            at = at.setdefault(key, {})
        at[last] = None

    def build(node):
        return leaf() if node is None else _object({k: build(v) for k, v in node.items()})

    out = {k: build(v) for k, v in tree.items()}
    if final:
        out["overall"] = leaf()
    return _object(out)


def _object(properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def answer_schema_text(paths: list[str], final: bool = True) -> str:
    return json.dumps(answer_schema(paths, final), sort_keys=True)


_KINDS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "null": "VOID"}


def _typed(value: Column, kind) -> Column:
    """Whether a variant is of a JSON type (or one of several)."""
    if isinstance(kind, (list, tuple)):
        out = F.lit(False)
        for k in kind:
            out = out | _typed(value, k)
        return out
    name = F.schema_of_variant(value)
    if kind == "number":
        return name.startswith("DECIMAL") | name.isin("BIGINT", "DOUBLE")
    if kind == "integer":
        return (name == "BIGINT") | (name.startswith("DECIMAL") & F.coalesce(value.cast("double") % 1 == 0, F.lit(False)))
    return name.startswith(_KINDS[kind])


def typed_violations(docs: DataFrame, doc: str, schema: dict) -> DataFrame:
    """Rows (.., path, problem) of JSON text against a JSON schema: malformed, type, missing, not allowed, extra.

    Served: type (one or several), enum, properties, required, additionalProperties
    false, items.  One pass: the schema is a fixed tree, so its checks are columns.
    """
    keep = [c for c in docs.columns if c != doc]
    rows = docs.select(*keep, F.try_parse_json(doc).alias("v"))
    problem = lambda path, word: F.array(F.struct(path.alias("path"), F.lit(word).alias("problem")))
    none = F.array().cast("array<struct<path:string,problem:string>>")

    def check(value: Column, node: dict, path: Column) -> Column:
        below = lambda key: F.when(path == "", F.lit(key)).otherwise(F.concat(path, F.lit("." + key)))
        fine = _typed(value, node["type"]) if "type" in node else F.lit(True)
        found = [none]
        if "enum" in node:
            found.append(F.when(~F.to_json(value).isin(*(json.dumps(x, ensure_ascii=False) for x in node["enum"])), problem(path, "not allowed")))
        if "properties" in node or node.get("additionalProperties") is False:
            inner = node.get("properties", {})
            is_map = F.schema_of_variant(value).startswith("OBJECT")
            for key, sub in inner.items():
                at = F.try_variant_get(value, f"$['{key}']", "variant")
                lost = problem(below(key), "missing") if key in node.get("required", ()) else none
                found.append(F.when(is_map, F.when(at.isNull(), lost).otherwise(check(at, sub, below(key)))))
            if node.get("additionalProperties") is False:
                extra = F.array_except(F.json_object_keys(F.to_json(value)), F.array(*map(F.lit, inner)).cast("array<string>"))
                found.append(F.when(is_map, F.transform(extra, lambda k: F.struct(F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k)).alias("path"), F.lit("extra").alias("problem")))))
        if "items" in node:
            cells = value.try_cast("array<variant>") if hasattr(value, "try_cast") else value.cast("array<variant>")
            each = F.transform(F.when(F.schema_of_variant(value).startswith("ARRAY"), cells), lambda x, i: check(x, node["items"], F.concat(path, F.lit(".["), i.cast("string"), F.lit("]"))))
            found.append(F.flatten(each))
        return F.when(~fine, problem(path, "type")).otherwise(F.concat(*(F.coalesce(f, none) for f in found)))

    whole = F.when(F.col("v").isNull(), problem(F.lit(""), "malformed")).otherwise(check(F.col("v"), schema, F.lit("")))
    return rows.select(*keep, F.explode(whole).alias("p")).select(*keep, "p.path", "p.problem")


def label_map(docs: DataFrame, doc: str, groups: tuple[str, ...]) -> DataFrame:
    """(.., path, label) below the groups: leaves with a label, and bare numeric leaves; `data.` is cut from paths."""
    rows = nodes(docs, doc)
    rows = rows.withColumn("path", F.regexp_replace("path", r"^data\.", ""))
    is_map, is_list = F.startswith(F.ltrim("value"), F.lit("{")), F.startswith(F.ltrim("value"), F.lit("["))
    own = F.when(is_map, F.get_json_object("value", "$.label"))
    bare = F.when(~is_map & ~is_list & F.col("value").try_cast("double").isNotNull() & ~F.regexp_like("path", F.lit(r"(^|\.)(text|label)$")), F.col("value"))
    keep = [c for c in docs.columns if c != doc]
    return rows.where(T.under(F.col("path"), groups)).select(*keep, "path", F.coalesce(own, bare).alias("label")).where("label is not null")


#: What an answer may say of a concept.
CONSISTENCY = ("consistent", "inconsistent", "unclear")


def consistency_schema(paths: list[str], final: bool = True) -> dict:
    """The strict schema of an answer on evidence: `concepts` nested by path, each leaf with its input echoed."""
    text = {"type": "string"}
    leaf = {"binary_cls_label": text, "initial_retrieved_text": text, "cls_text_consistency": {"type": "string", "enum": list(CONSISTENCY)}}
    if final:
        leaf["final_text"] = text
    leaf["consistency_feedback"] = text
    tree: dict = {}
    for path in paths:
        at = tree
        for key in path.split("."):
            at = at.setdefault(key, {})

    def build(node: dict) -> dict:
        return _object({k: build(v) for k, v in node.items()}) if node else _object(dict(leaf))

    return _object({"overall_consistency_feedback": text, "concepts": build(tree) if tree else _object({})})


def echo_violations(answers: DataFrame, expected: DataFrame, *, key: str = "case_id", doc: str = "answer", final: bool = True) -> DataFrame:
    """(key, path, problem) of answers against expected (key, path, label, text): the fields there, the word allowed, the input unchanged."""
    fields = ["binary_cls_label", "initial_retrieved_text", "cls_text_consistency", *(["final_text"] if final else []), "consistency_feedback"]
    docs = answers.select(key, F.try_parse_json(doc).alias("v"))
    top = docs.select(key, F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), F.array(F.lit("no object"))).otherwise(
        F.filter(F.array(*(F.when(F.try_variant_get("v", f"$.{k}", "variant").isNull(), F.lit(f"missing {k}")) for k in ("overall_consistency_feedback", "concepts"))), lambda x: x.isNotNull())).alias("problems"))
    whole = top.select(key, F.lit("").alias("path"), F.explode("problems").alias("problem"))
    good = docs.join(top.where(F.size("problems") == 0).select(key), key).select(key, F.to_json(F.try_variant_get("v", "$.concepts", "variant")).alias("concepts"))
    paths = [r["path"] for r in expected.select("path").distinct().orderBy("path").collect()]
    leaf = F.coalesce(*(F.when(F.col("path") == p, F.get_json_object("concepts", json_path(p))) for p in paths), F.lit(None).cast("string"))
    rows = expected.join(good, key).withColumn("leaf", leaf)
    at = lambda f: F.get_json_object("leaf", f"$.{f}")
    absent = [F.when(~F.array_contains(F.coalesce(F.json_object_keys("leaf"), F.array().cast("array<string>")), f), F.lit(f"missing {f}")) for f in fields]
    wrong = [
        F.when(~F.coalesce(at("cls_text_consistency"), F.lit("")).isin(*CONSISTENCY), F.lit("not allowed")), F.when(F.coalesce(at("binary_cls_label"), F.lit("")) != F.col("label"), F.lit("label changed")),
        F.when(F.trim(F.coalesce(at("initial_retrieved_text"), F.lit(""))) != F.trim("text"), F.lit("text changed")),
    ]
    is_leaf = F.startswith(F.ltrim("leaf"), F.lit("{"))
    first = F.coalesce(F.when(~F.coalesce(is_leaf, F.lit(False)), F.lit("missing leaf")), *absent, *wrong)
    return rows.select(key, "path", first.alias("problem")).where("problem is not null").unionByName(whole)
