"""Registered queries of files of label maps, of work across tiles, and of histograms, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators import tiled, tissue, track
from labelloom.plans.imaging import CLOSE, DARK, ROUND, P, R, _parts_sql, clamp, greys
from labelloom.plans.registry import query, r6
from labelloom.sources import images, matfiles
from labelloom.sources.storage import shared_folder
from labelloom.sources.views import object_id, patches, read
from labelloom.sources.views import raster as raster_view

#: Tiles of 8 over images of 20: seams both ways, and a last tile that is cut.
TILE = 8
PARTS = f"{DARK.replace('WITH ', 'WITH RECURSIVE ', 1)}, {{}}"


def _sizes(spark: SparkSession, sf_dir: str, side: int = 20) -> DataFrame:
    return greys(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(side).alias("height"), F.lit(side).alias("width"))


def _dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.binary(greys(spark, sf_dir))


@query(PARTS.format(_parts_sql(CLOSE)) + " SELECT image_id, CAST(p // 20 AS INT) AS y, CAST(p % 20 AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY f) AS INT) AS inst_id FROM first")
def parts_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled.connected_parts(_dark(spark, sf_dir), tile=TILE)


@query(PARTS.format(_parts_sql(ROUND)) + " SELECT image_id, CAST(p // 20 AS INT) AS y, CAST(p % 20 AS INT) AS x FROM first WHERE n >= 6")
def small_parts_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled.remove_small_parts(_dark(spark, sf_dir), 6, True, TILE)


#: Background by the parts that it makes; a part that reaches the edge is no hole.
HOLES = f"""light AS (SELECT i.image_id, CAST(ty.y AS INT) AS y, CAST(tx.x AS INT) AS x FROM (SELECT DISTINCT image_id FROM q) i, range(20) ty(y), range(20) tx(x) WHERE (i.image_id, ty.y, tx.x) NOT IN (SELECT image_id, y, x FROM dark)),
    {_parts_sql(CLOSE).replace('dark', 'light')}"""


@query(PARTS.format(HOLES) + ", edge AS (SELECT image_id, f FROM first GROUP BY ALL HAVING min(p // 20) = 0 OR min(p % 20) = 0 OR max(p // 20) = 19 OR max(p % 20) = 19) SELECT image_id, y, x FROM dark UNION ALL SELECT f.image_id, CAST(p // 20 AS INT), CAST(p % 20 AS INT) FROM first f ANTI JOIN edge e ON e.image_id = f.image_id AND e.f = f.f")
def holes_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled.filled(_dark(spark, sf_dir), _sizes(spark, sf_dir), TILE)


@query(f"{DARK}, k(dy, dx) AS (SELECT a.i - 2, b.i - 2 FROM range(5) a(i), range(5) b(i) WHERE (a.i - 2) * (a.i - 2) + (b.i - 2) * (b.i - 2) <= 4) SELECT DISTINCT image_id, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM dark, k WHERE y + dy BETWEEN 0 AND 19 AND x + dx BETWEEN 0 AND 19")
def grown_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled.dilated(_dark(spark, sf_dir), _sizes(spark, sf_dir), 2, TILE)


#: A cross of five pixels; what lies outside the image is no reason to erode.
OPEN = "k(dy, dx) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)), gone AS (SELECT DISTINCT d.image_id, d.y, d.x FROM dark d, k WHERE d.y + dy BETWEEN 0 AND 19 AND d.x + dx BETWEEN 0 AND 19 AND (d.image_id, d.y + dy, d.x + dx) NOT IN (SELECT image_id, y, x FROM dark)), kept AS (SELECT image_id, y, x FROM dark EXCEPT SELECT * FROM gone)"


@query(f"{DARK}, {OPEN} SELECT DISTINCT image_id, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM kept, k WHERE y + dy BETWEEN 0 AND 19 AND x + dx BETWEEN 0 AND 19")
def opened_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled.opened(_dark(spark, sf_dir), _sizes(spark, sf_dir), 3, TILE)


_TAPS = ", ".join(f"({i - 2}, {j - 2}, {a * b})" for i, a in enumerate((-0.125, -0.25, 0.0, 0.25, 0.125)) for j, b in enumerate((0.0625, 0.25, 0.375, 0.25, 0.0625)) if a)
_MIRROR = "least(abs({0}), 14 - abs({0}))"


@query(f"{P}, k(dy, dx, w) AS (VALUES {_TAPS}), d AS (SELECT p.image_id, p.y, p.x, sum(q.v * k.w) AS out FROM patches p, k JOIN patches q ON q.image_id = p.image_id AND q.y = {_MIRROR.format('(p.y + k.dy)')} AND q.x = {_MIRROR.format('(p.x + k.dx)')} GROUP BY ALL) SELECT image_id, y, x, round(out, 6) AS out FROM d WHERE out <> 0")
def derivative_across_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return r6(tiled.derivative(patches(spark, sf_dir), sizes, "v", 0, 5, 3), "out")


@query("""WITH e AS (SELECT vec_id, i - 1 AS i, CAST(floor(abs(v) * 20) AS INT) AS inst FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
    k AS (SELECT CAST(vec_id // 16 AS VARCHAR) AS image_id, CAST(vec_id % 16 // 4 * 8 + i // 8 AS INT) AS y, CAST(vec_id % 4 * 8 + i % 8 AS INT) AS x, inst AS inst_id, CAST((inst * 3 + i) % 8 AS INT) AS k FROM e WHERE inst > 0)
    SELECT image_id, y, x, inst_id, CASE WHEN k IN (3, 4) THEN 3 WHEN k IN (5, 6, 7) THEN 4 ELSE k END AS type_id FROM k""")
def mat_label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps of 32 x 32, 16 vectors each, written as MAT files into the shared folder and read back as those of a data set."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    place = F.expr("(vec_id % 16 div 4 * 8 + i div 8) * 32 + vec_id % 4 * 8 + i % 8").alias("at")
    inst = object_id(F.col("v"))
    pixels = e.select(F.expr("vec_id div 16").alias("image_id"), place, inst.alias("inst"), ((inst * 3 + F.col("i")) % 8).alias("type"))
    maps = pixels.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("inst", "type")))).alias("m"))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(32 * 32 - 1)), lambda p: F.coalesce(F.try_element_at("m", p.cast("long"))[c], F.lit(0)))
    maps = maps.select("image_id", F.lit(32).alias("height"), F.lit(32).alias("width"), dense("inst").alias("inst_map"), dense("type").alias("type_map"))
    folder = f"{shared_folder(spark)}/mat-{uuid.uuid4().hex}"
    matfiles.write_mat(matfiles.as_files(maps), folder)
    return images.read_labels(spark, "consep", folder, True, mat=True)


@query(f"{R}, h AS (SELECT image_id, true_id % 3 AS layer, CAST(least(floor(v / 50), 7) AS INT) AS bin, count(*) AS n FROM raster WHERE v BETWEEN 0 AND 400 GROUP BY ALL), k AS (SELECT DISTINCT image_id, true_id % 3 AS layer FROM raster) SELECT k.image_id, k.layer, CAST(b.i AS INT) AS bin, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM k, range(8) b(i) LEFT JOIN h ON h.image_id = k.image_id AND h.layer = k.layer AND h.bin = b.i")
def layer_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every layer and step in fixed bins, empty ones too, from the histograms of two halves of the rows."""
    rows = raster_view(spark, sf_dir).select("image_id", (F.col("true_id") % 3).alias("layer"), "v", "y")
    keys = ["image_id", "layer"]
    halves = [track.fixed_histogram(rows.where(f"y % 2 = {k}"), keys, "v", 0, 400, 8) for k in (0, 1)]
    return track.merged_histogram(halves[0].unionByName(halves[1]), keys)


SHAPE = (2, 4, 2, 4)


@query("""WITH p AS (SELECT vec_id, embedding, ['conv/W', 'conv/b', 'bn/W', 'unit/shortcut/W', 'linear/W'][CAST(vec_id % 5 AS INT) + 1] AS old FROM embeddings WHERE vec_id % 5 < 4),
    n AS (SELECT vec_id, embedding, CASE old WHEN 'conv/W' THEN 'd0.conv.weight' WHEN 'conv/b' THEN 'd0.conv.bias' WHEN 'bn/W' THEN 'd0.conv_bn.weight' ELSE 'd0.shortcut.weight' END AS name FROM p)
    SELECT vec_id, name, CASE WHEN name IN ('d0.conv.weight', 'd0.shortcut.weight') THEN '4,2,2,4' ELSE '2,4,2,4' END AS shape, CAST(i AS INT) AS place,
        CASE WHEN name IN ('d0.conv.weight', 'd0.shortcut.weight') THEN embedding[1 + (i // 4 % 2) * 32 + (i % 4) * 8 + (i // 8 % 2) * 4 + i // 16] ELSE embedding[1 + i] END AS v
    FROM n, range(64) r(i)""")
def renamed_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as parameters of shape 2 x 4 x 2 x 4, under new names, weights of convolutions and shortcuts turned."""
    from labelloom.functions import tensors

    old = F.element_at(F.array(*map(F.lit, ("conv/W", "conv/b", "bn/W", "unit/shortcut/W", "linear/W"))), (F.col("vec_id") % 5 + 1).cast("int"))
    params = read(spark, sf_dir, "embeddings").select("vec_id", old.alias("name"), F.array(*map(F.lit, SHAPE)).alias("shape"), F.col("embedding").alias("values"))
    names = spark.createDataFrame([("conv/W", "d0.conv.weight"), ("conv/b", "d0.conv.bias"), ("bn/W", "d0.conv_bn.weight"), ("unit/shortcut/W", "d0.shortcut.weight")], "old string, new string")
    out = tensors.renamed(params, names, keep=["vec_id"])
    return out.select("vec_id", "name", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), F.posexplode("values").alias("place", "v"))


@query(f"{R}, b(box, y0, x0, y1, x1) AS (VALUES (0, 3, 4, 11, 9), (1, 0, 12, 30, 18)) SELECT image_id, b.box, y, x, r FROM raster JOIN b ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 WHERE image_id % 2 = 0")
def regions_of_a_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes of every other image, from pixels that are laid out in Morton order in the shared folder."""
    from labelloom.sources import regions

    pixels = raster_view(spark, sf_dir).select("image_id", "y", "x", "r")
    path = f"{shared_folder(spark)}/regions-{uuid.uuid4().hex}"
    regions.write_regions(pixels, path, 4, 2048)
    return regions.read_regions(spark, path, [(None, 3, 4, 11, 9), (None, 0, 12, 30, 18)], 4).where("image_id % 2 = 0")
