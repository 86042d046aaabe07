"""Object records: JSON documents, QuPath rows, and what has not been written yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.scalar import rgb2int

RECORD = "struct<bbox:array<array<int>>,centroid:array<double>,contour:array<array<int>>,type_prob:double,type:int>"
DOCUMENT = f"mag double, nuc map<string,{RECORD}>"


def to_documents(objects: DataFrame, mag: Column | None = None) -> DataFrame:
    """objects: image_id, inst_id and the fields of RECORD. One JSON text per image."""
    names = ["bbox", "centroid", "contour", "type_prob", "type"]
    have = [F.col(c) if c in objects.columns else F.lit(None) for c in names]
    record = F.struct(*(c.alias(n) for c, n in zip(have, names, strict=True))).cast(RECORD)
    nuc = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("inst_id").cast("string").alias("key"), record.alias("value")))))
    packed = objects.groupBy("image_id").agg(nuc.alias("nuc"))
    return packed.select("image_id", F.to_json(F.struct((mag if mag is not None else F.lit(None)).cast("double").alias("mag"), "nuc"), {"ignoreNullFields": "false"}).alias("json"))


def from_documents(texts: DataFrame, strict: bool = False) -> DataFrame:
    """texts: image_id, json. One row per object; what is no document gives none, or with `strict` ends the job."""
    parsed = texts.select("image_id", F.from_json("json", DOCUMENT, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("d"))
    return parsed.select("image_id", F.col("d.mag").alias("mag"), F.explode("d.nuc").alias("inst_id", "r")).select("image_id", "mag", F.col("inst_id").cast("int").alias("inst_id"), "r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of objects; image_id is the file's stem."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("image_id", F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1))
    return raw.select("image_id", "mag", F.explode("nuc").alias("inst_id", "r")).select("image_id", "mag", F.col("inst_id").cast("int").alias("inst_id"), "r.*")


def qupath_rows(objects: DataFrame, types: DataFrame, scale: float = 1.0) -> DataFrame:
    """objects: cx, cy, type_id. Columns x, y, class (empty), name, color; coordinates are scaled and cut to whole numbers. An object of a type that is not listed ends the job."""
    known = types.select("type_id", F.col("name").alias("_name"), "r", "g", "b", F.lit(True).alias("_listed"))
    lost = F.raise_error(F.concat(F.lit("no such type: "), F.coalesce(F.col("type_id").cast("string"), F.lit("none")))).cast("string")
    joined = objects.join(known, "type_id", "left").withColumn("name", F.when(F.col("_listed"), F.col("_name")).otherwise(lost))
    cut = lambda c: (F.col(c) * scale).cast("int")
    return joined.select(*[c for c in ("image_id", "inst_id") if c in objects.columns], cut("cx").alias("x"), cut("cy").alias("y"), F.lit("").alias("class"), "name", rgb2int(F.col("r"), F.col("g"), F.col("b")).alias("color"))


def write_qupath(rows: DataFrame, path: str) -> None:
    """One file with one header for each image: in a folder image_id=..., or the only file, if rows are of one image and have no image_id."""
    by_image = "image_id" in rows.columns
    out = rows.select(*(["image_id"] if by_image else []), "x", "y", "class", "name", "color")
    writer = (out.repartition("image_id") if by_image else out.repartition(1)).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "")
    (writer.partitionBy("image_id") if by_image else writer).csv(path)


def read_types(spark: SparkSession, path: str) -> DataFrame:
    """type_id, name, r, g, b of a JSON file {"0": ["name", [r, g, b]], ...}."""
    texts = spark.read.text(path, wholetext=True)
    entries = texts.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("k", "v"))
    colour = F.from_json(F.col("v")[1], "array<int>")
    return entries.select(F.col("k").cast("int").alias("type_id"), F.col("v")[0].alias("name"), *(colour[i].alias(c) for i, c in enumerate("rgb")))


def checked_types(types: DataFrame, n: int) -> DataFrame:
    """types, if it has all ids under n; one that it lacks ends the job."""
    lacking = missing_types(types, n).limit(1).collect()
    if lacking:
        raise ValueError(f"type {lacking[0].type_id} is not defined")
    return types


def default_types(spark: SparkSession, n: int) -> DataFrame:
    """Types 0 to n - 1, named by number, in the first colours of a black-red-yellow-white map."""
    from labelloom.functions.colour import ember

    return spark.createDataFrame([(i, str(i), *ember(i)) for i in range(n)], "type_id int, name string, r int, g int, b int")


def missing_types(types: DataFrame, n: int) -> DataFrame:
    """Ids under n that the type dictionary lacks."""
    return types.sparkSession.range(n).select(F.col("id").cast("int").alias("type_id")).join(types, "type_id", "left_anti")


def not_done(inputs: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    return inputs.join(done, key, "left_anti")


def stripped_keys(params: Column, prefix: str = "module.") -> Column:
    """A map's keys without the prefix, if all have it."""
    every = F.forall(F.map_keys(params), lambda k: k.startswith(prefix))
    return F.when(every, F.transform_keys(params, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))).otherwise(params)
