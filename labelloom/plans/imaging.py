"""Registered queries of readers, patches, augmentation, colours, tracked values and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import colour, scalar
from labelloom.operators import grid, instances, metrics, raster, sampling, tissue, track
from labelloom.plans import runs
from labelloom.plans.registry import query, r6
from labelloom.sources import documents, images
from labelloom.sources.views import PATCHES_SQL, RASTER_SQL, label_map, object_id, patches, read
from labelloom.sources.views import raster as raster_view

P = f"WITH {PATCHES_SQL}"
R = f"WITH {RASTER_SQL}"
LAB = f"{R}, lab AS (SELECT image_id, y, x, true_id AS inst_id, type_id FROM raster WHERE true_id > 0)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_map(raster_view(spark, sf_dir), "true_id")


def clamp(v: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {v}))"


def drawn_sql(key: str, seed: int, stream: int) -> str:
    return f"((('0x' || substr(md5('{seed}:{stream}:' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query(f"{P} SELECT image_id, y - 1 AS y, x - 1 AS x, v, label FROM patches WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 6")
def crop_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.crop_to(patches(spark, sf_dir), 8, 8, 5, 6)


@query(f"{LAB}, b AS (SELECT image_id, inst_id, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM lab GROUP BY ALL) SELECT image_id, inst_id, greatest(0, y0 - 3) AS y0, greatest(0, x0 - 3) AS x0, least(20, y1 + 3) AS y1, least(20, x1 + 3) AS x1 FROM b")
def clamped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = instances.boxes(truth(spark, sf_dir)).withColumns({"height": F.lit(20), "width": F.lit(20)})
    return raster.clamped(boxes, 3).select("image_id", "inst_id", "y0", "x0", "y1", "x1")


@query(f"{R} SELECT image_id, y, x, CAST(trunc(255 * r / nullif(max(r) OVER (PARTITION BY image_id), 0)) AS INT) AS scaled FROM raster")
def max_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.by_maximum(raster_view(spark, sf_dir), "r").select("image_id", "y", "x", "scaled")


@query(f"{P}, i AS (SELECT DISTINCT image_id FROM patches), c AS (SELECT image_id, CAST(ty.y AS INT) AS y, CAST(tx.x AS INT) AS x FROM i, range(11) ty(y), range(11) tx(x)) SELECT c.image_id, c.y, c.x, coalesce(p.v, 0.0) AS v FROM c LEFT JOIN patches p ON p.image_id = c.image_id AND p.y + 1 = c.y AND p.x + 1 = c.x")
def same_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.same_pad(patches(spark, sf_dir), 8, 8, 5, 3)


def _blur_sql(ky: int, kx: int) -> str:
    taps = ", ".join(f"({i - ky // 2}, {j - kx // 2}, {a * b})" for i, a in enumerate(raster.BLUR[ky]) for j, b in enumerate(raster.BLUR[kx]))
    return f"{P}, k(dy, dx, w) AS (VALUES {taps}) SELECT p.image_id, p.y, p.x, round(sum(q.v * k.w), 6) AS out FROM patches p, k JOIN patches q ON q.image_id = p.image_id AND q.y = {clamp('p.y + k.dy', '0', '7')} AND q.x = {clamp('p.x + k.dx', '0', '7')} GROUP BY ALL"


@query(_blur_sql(5, 3))
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(raster.gaussian_blur(patches(spark, sf_dir), 8, 8, 5, 3), "out")


@query(f"{P}, k AS (SELECT a.i - 1 AS dy, b.i - 1 AS dx FROM range(3) a(i), range(3) b(i)) SELECT p.image_id, p.y, p.x, list_sort(list(q.v))[5] AS out FROM patches p, k JOIN patches q ON q.image_id = p.image_id AND q.y = {clamp('p.y + k.dy', '0', '7')} AND q.x = {clamp('p.x + k.dx', '0', '7')} GROUP BY ALL")
def median_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.median_blur(patches(spark, sf_dir), 8, 8, 3)


@query(f"{P} SELECT image_id, CASE WHEN {drawn_sql('image_id', 3, 2)} < 0.5 THEN 7 - y ELSE y END AS y, CASE WHEN {drawn_sql('image_id', 3, 1)} < 0.5 THEN 7 - x ELSE x END AS x, v, label FROM patches")
def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.flipped(patches(spark, sf_dir), 8, 8, seed=3)


NOISE_KEY = "image_id || ',' || y || ',' || x"


@query(f"{R} SELECT image_id, y, x, round(greatest(0.0, least(255.0, r + 12.75 * sqrt(-2.0 * ln({drawn_sql(NOISE_KEY, 5, 3)})) * cos(2 * 3.141592653589793 * {drawn_sql(NOISE_KEY, 5, 4)}))), 6) AS out FROM raster")
def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(raster.noisy(raster_view(spark, sf_dir), 12.75, 5, "r").select("image_id", "y", "x", "out"), "out")


MATRIX = raster.affine_matrix(8, 8, (1.1, 0.9), 25.0, 4.0, (0.3, -0.2))


@query(f"""{P}, i AS (SELECT DISTINCT image_id FROM patches), c AS (SELECT image_id, CAST(ty.y AS INT) AS y, CAST(tx.x AS INT) AS x FROM i, range(8) ty(y), range(8) tx(x)),
    s AS (SELECT *, CAST(round_even({MATRIX[3]!r}::DOUBLE * x + {MATRIX[4]!r}::DOUBLE * y + {MATRIX[5]!r}::DOUBLE, 0) AS INT) AS sy, CAST(round_even({MATRIX[0]!r}::DOUBLE * x + {MATRIX[1]!r}::DOUBLE * y + {MATRIX[2]!r}::DOUBLE, 0) AS INT) AS sx FROM c)
    SELECT s.image_id, s.y, s.x, coalesce(p.v, 0.0) AS v FROM s LEFT JOIN patches p ON p.image_id = s.image_id AND p.y = s.sy AND p.x = s.sx""")
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.affine(patches(spark, sf_dir), 8, 8, MATRIX)


def _resize_sql(factor: float, how: str) -> str:
    n = int(8 * factor + 0.5)
    near, far = "((1.25 * {0} - 2.25) * {0} * {0} + 1)", "(((-0.75 * {0} + 3.75) * {0} - 6.0) * {0} + 3.0)"
    taps = {0: "1 - r", 1: "r"} if how == "linear" else {-1: far.format("(r + 1)"), 0: near.format("r"), 1: near.format("(1 - r)"), 2: far.format("(2 - r)")}
    each = " UNION ALL ".join(f"SELECT at_, {clamp(f'f + {k}', '0', '7')} AS src, {w} AS w FROM b" for k, w in taps.items())
    return f"""{P}, a AS (SELECT CAST(i AS INT) AS at_, (i + 0.5::DOUBLE) / {factor} - 0.5 AS s FROM range({n}) r(i)), b AS (SELECT at_, CAST(floor(s) AS INT) AS f, s - floor(s) AS r FROM a), t AS (SELECT at_, src, sum(w) AS w FROM ({each}) GROUP BY ALL)
    SELECT p.image_id, ty.at_ AS y, tx.at_ AS x, round(sum(p.v * ty.w * tx.w), 6) AS out FROM patches p JOIN t ty ON ty.src = p.y JOIN t tx ON tx.src = p.x GROUP BY ALL"""


def _patch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query(_resize_sql(1.5, "cubic"))
def resize_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(raster.resize(patches(spark, sf_dir), _patch_sizes(spark, sf_dir), 1.5), "out")


@query(_resize_sql(0.625, "linear"))
def resize_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(images.prepared_level(patches(spark, sf_dir), _patch_sizes(spark, sf_dir), 0.625), "out")


@query(f"{R} SELECT image_id, y - 4 AS y, x - 6 AS x, r, g, b FROM raster WHERE y >= 4 AND y < 13 AND x >= 6 AND x < 17")
def read_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.region(raster_view(spark, sf_dir).select("image_id", "y", "x", "r", "g", "b"), 2, 3, 9, 11, up=2.0)


ENDINGS = [".svs", ".png", ".NDPI", ".tiff", ".jpeg"]
DOWN = [1.0, 2.0, 4.0, 16.0]


@query(f"SELECT p_partkey AS slide_id, CAST(i - 1 AS INT) AS level, 40.0 / [{', '.join(map(str, DOWN))}][i] AS mag, (p_partkey % 5) IN (0, 2, 3) AS known FROM part, range(1, 5) r(i)")
def slide_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    s = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.concat(F.lit("/slides/a.b"), ending).alias("path"))
    mags = images.magnifications(F.lit(40.0), F.array(*map(F.lit, DOWN)))
    return s.select("slide_id", F.posexplode(mags).alias("level", "mag"), images.is_slide(F.col("path")).alias("known"))


@query("""WITH e AS (SELECT vec_id AS image_id, i - 1 AS i, CAST(floor(abs(v) * 20) AS INT) AS inst_id, CAST(i % 8 AS INT) AS k FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))
    SELECT image_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, inst_id, CASE WHEN k IN (3, 4) THEN 3 WHEN k IN (5, 6, 7) THEN 4 ELSE k END AS type_id FROM e WHERE inst_id > 0""")
def typed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense maps of instances and types to merged sparse labels."""
    e = read(spark, sf_dir, "embeddings")
    maps = e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.transform("embedding", object_id).alias("inst_map"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 8).cast("int")).alias("type_map"))
    return images.DATASETS["consep"](maps, True)


@query("SELECT s_name AS stem, '/truth/' || s_name || '.a.mat' AS true_path, '/pred/' || s_name || '.mat' AS pred_path FROM supplier WHERE s_suppkey % 3 = 0")
def truth_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    side = lambda df, folder, end: df.select(F.concat(F.lit(folder), "s_name", F.lit(end)).alias("path"))
    return metrics.by_stem(side(s, "/truth/", ".a.mat"), side(s.where("s_suppkey % 3 = 0"), "/pred/", ".mat"))


@query("SELECT i.n_name AS stem, n_nationkey AS size, r_name AS split FROM nation i JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 > 0 AND n_nationkey % 5 > 0")
def annotated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_name", "stem")
    split = n.join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("stem", F.col("r_name").alias("split"))
    return images.annotated(n.where("n_nationkey % 4 > 0").select("stem", F.col("n_nationkey").alias("size")), n.where("n_nationkey % 5 > 0").select("stem"), split)


@query(f"{R} SELECT image_id, true_id, pred_id, count(*) AS n FROM raster WHERE true_id > 0 OR pred_id > 0 GROUP BY ALL")
def located_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = raster_view(spark, sf_dir)
    return metrics.contingency(metrics.located(label_map(pixels, "true_id"), label_map(pixels, "pred_id")))


OPEN = "p AS (SELECT * FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN -1 WHEN doc_id % 7 <> 0 THEN quality END AS t, CASE WHEN doc_id % 11 <> 0 THEN toxic END AS q FROM labels) WHERE t IS NOT NULL OR q IS NOT NULL)"


@query(f"""WITH {OPEN}, c AS (SELECT count(*) FILTER (WHERE t IS NOT NULL AND q IS NOT NULL) AS tp, count(*) FILTER (WHERE t = -1 AND q IS NOT NULL) AS skip, count(*) FILTER (WHERE t IS NULL) AS fp, count(*) FILTER (WHERE q IS NULL) AS fn, count(*) FILTER (WHERE t = q) AS eq,
        count(*) FILTER (WHERE t = 1 AND q = 1) AS a, count(*) FILTER (WHERE t = 0 AND q = 1) AS b, count(*) FILTER (WHERE t = 1 AND q = 0) AS d, count(*) FILTER (WHERE t IS NULL AND q = 1) AS e, count(*) FILTER (WHERE q IS NULL AND t = 1) AS f FROM p)
    SELECT round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_d, round(1.0 * eq / (tp - skip), 6) AS acc_type, round(2.0 * a / (2 * a + 2 * b + 2 * d + e + f), 6) AS f1_1 FROM c""")
def type_f1_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth object is not judged."""
    d = F.col("doc_id")
    p = read(spark, sf_dir, "labels").select(F.when(d % 5 == 0, -1).when(d % 7 != 0, F.col("quality")).alias("true_type"), F.when(d % 11 != 0, F.col("toxic")).alias("pred_type")).where("true_type is not null or pred_type is not null")
    return r6(p.agg(*metrics.detection_scores(False), metrics.pair_f1(F.lit(1), exhaustive=False).alias("f1_1")), "f1_d", "acc_type", "f1_1")


@query(f"{R}, q AS (SELECT image_id, CAST(true_id > 0 AS DOUBLE) AS t, (g + 1) / 257.0::DOUBLE AS p FROM raster) SELECT image_id, round(2.0 - (2.0 * sum(t * p) + 1e-3) / (sum(t) + sum(p) + 1e-3) - (2.0 * sum((1 - t) * (1 - p)) + 1e-3) / (sum(1 - t) + sum(1 - p) + 1e-3), 6) AS loss FROM q GROUP BY image_id")
def dice_loss_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = raster_view(spark, sf_dir).select("image_id", (F.col("true_id") > 0).cast("double").alias("t"), ((F.col("g") + 1) / 257.0).alias("p"))
    q = q.withColumns({"t0": 1 - F.col("t"), "p0": 1 - F.col("p")})
    return r6(q.groupBy("image_id").agg(track.dice_losses([("t", "p"), ("t0", "p0")]).alias("loss")), "loss")


WEIGHTS = [("click", "0", 1.0), ("click", "1", 2.0), ("view", "0", 0.5), ("purchase", "1", 4.0)]
TERMS = "terms AS (SELECT event_id // 100 AS step, event_type AS branch, CAST(user_id % 2 AS VARCHAR) AS loss, value FROM events)"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("step"), F.col("event_type").alias("branch"), (F.col("user_id") % 2).cast("string").alias("loss"), "value")


@query(f"WITH {TERMS}, w(branch, loss, weight) AS (VALUES {', '.join(map(str, WEIGHTS))}) SELECT step, round(sum(weight::DOUBLE * value), 4) AS total FROM terms JOIN w ON w.branch = terms.branch AND w.loss = terms.loss GROUP BY step")
def loss_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(WEIGHTS, "branch string, loss string, weight double")
    return track.weighted_total(terms(spark, sf_dir), weights).withColumn("total", F.round("total", 4))


@query(f"WITH {TERMS} SELECT branch || '.' || CASE WHEN loss = '0' THEN 'weight' ELSE 'scale' END AS layer, round(avg(abs(value - 50)), 6) AS mean_abs, max(abs(value - 50)) AS max_abs FROM terms WHERE step % 3 > 0 GROUP BY ALL")
def gradient_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terms(spark, sf_dir)
    name = F.when(F.col("step") % 3 == 0, "bias").when(F.col("loss") == "0", "weight").otherwise("scale")
    return r6(track.gradient_flow(t.select(F.concat_ws(".", "branch", name).alias("layer"), (F.col("value") - 50).alias("value"))), "mean_abs")


@query(f"WITH {TERMS}, s AS (SELECT step AS epoch, branch, CASE WHEN count(*) FILTER (WHERE loss = '1') > 0 THEN max(value) FILTER (WHERE loss = '1') END AS v FROM terms GROUP BY ALL) SELECT epoch, 'scalar' AS kind, 'train-' || branch AS name, printf('%.5f', v) AS value FROM s WHERE v IS NOT NULL")
def console_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked outputs as maps, flattened and written as for a console."""
    t = terms(spark, sf_dir).groupBy(F.col("step").alias("epoch"), "branch").agg(F.max(F.when(F.col("loss") == "1", F.col("value"))).alias("v"))
    outputs = t.groupBy("epoch").agg(F.map_from_entries(F.collect_list(F.struct("branch", "v"))).alias("values")).withColumn("kind", F.lit("scalar"))
    return track.serialised(track.flattened(outputs, "train"), "console")


@query("SELECT quality AS True, toxic AS Pred, count(*) AS value FROM labels GROUP BY ALL")
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = read(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).count()
    return track.confusion_long(wide, "quality", {"0": 0, "1": 1}).where("value > 0")


TURNS = "t AS (SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS v FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("v"))


@query(f"""WITH {TURNS}, w AS (SELECT *, max(v) OVER o AS hi, min(v) OVER o AS lo FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, '>=' AS comparator, v = hi AS is_best FROM w UNION ALL SELECT conv_id, turn, '<=', v = lo FROM w UNION ALL SELECT conv_id, turn, '>', false FROM w UNION ALL SELECT conv_id, turn, '<', false FROM w""")
def conditional_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [track.saves(turns(spark, sf_dir), "conv_id", "turn", "v", c).select("conv_id", "turn", F.lit(c).alias("comparator"), "is_best") for c in (">=", "<=", ">", "<")]
    return track.accumulated(each)


@query(f"WITH {TURNS}, e AS (SELECT max(conv_id) AS epoch FROM t) SELECT g.epoch, s.v AS value, 1e-4 * pow(0.1, floor(g.epoch / 25)) AS rate FROM (SELECT DISTINCT conv_id AS epoch FROM t WHERE conv_id % 10 = 0 UNION SELECT epoch FROM e) g LEFT JOIN (SELECT conv_id, v FROM t WHERE turn = 0) s ON s.conv_id = g.epoch")
def epoch_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs at which a periodic save is due and the last one, with a metric and the learning rate."""
    stats = turns(spark, sf_dir).select(F.col("conv_id").alias("epoch"), F.concat(F.lit("m"), "turn").alias("metric"), F.col("v").alias("value"))
    due = track.every(stats, "epoch", 10).select("epoch").unionByName(track.last_epoch(stats)).distinct()
    return track.with_epoch(stats, due, "m0").withColumn("rate", track.step_rate(F.col("epoch")))


RANKED = "r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('9:' || c_custkey)) - 1 AS rank, count(*) OVER () AS n FROM customer)"


@query(f"WITH {RANKED} SELECT c_custkey, rank, rank // 32 AS batch, rank % 32 AS place FROM r WHERE rank // 32 < n // 32")
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.training_order(read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey"), 32, 9, True)


@query("SELECT c_custkey, rank, rank // 32 AS batch, rank % 32 AS place FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer)")
def validation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.training_order(read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey"), 32, 9, False)


@query(f"WITH {RANKED}, d AS (SELECT i AS draw, CAST(floor(('0x' || substr(md5('10:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT count(*) FROM customer)) AS BIGINT) AS rank FROM range(8) t(i)) SELECT d.draw, r.c_custkey FROM d JOIN r ON r.rank = d.rank")
def drawn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows, with replacement; so many is what is asked for."""
    return sampling.drawn(read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey"), 8, 9)


HSV = f"""{R}, m AS (SELECT *, greatest(r, g, b) AS v_, least(r, g, b) AS lo FROM raster),
    h AS (SELECT image_id, y, x, r, g, b, v_::DOUBLE AS val, CASE WHEN v_ = 0 THEN 0.0 ELSE 255.0 * (v_ - lo) / v_ END AS sat, 30.0::DOUBLE * CASE WHEN v_ = lo THEN 0.0 WHEN v_ = r THEN (g - b) / (v_ - lo)::DOUBLE WHEN v_ = g THEN 2.0 + (b - r) / (v_ - lo)::DOUBLE ELSE 4.0 + (r - g) / (v_ - lo)::DOUBLE END AS turn FROM m),
    hsv AS (SELECT *, CASE WHEN turn < 0 THEN turn + 180 ELSE turn END AS hue FROM h)"""


@query(f"{HSV} SELECT image_id, y, x, round(hue, 6) AS hue, round(sat, 6) AS sat, val FROM hsv")
def hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, s, v = colour.hsv(F.col("r"), F.col("g"), F.col("b"))
    return r6(raster_view(spark, sf_dir).select("image_id", "y", "x", h.alias("hue"), s.alias("sat"), v.alias("val")), "hue", "sat")


def _wheel_sql(hue: str, sat: str, val: str, n: int) -> str:
    k = f"(({hue}) / 30.0 + {n} - 6 * floor((({hue}) / 30.0 + {n}) / 6))"
    return f"CAST(floor({val} - {val} * {sat} / 255.0 * greatest(0.0, least({k}, 4.0 - {k}, 1.0)) + 0.5) AS INT)"


@query(f"{HSV} SELECT image_id, y, x, {', '.join(f'{_wheel_sql("hue + 8.3", "sat", "val", n)} AS {c}' for n, c in ((5, 'r'), (3, 'g'), (1, 'b')))} FROM hsv")
def hue_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = colour.hue_turned(F.col("r"), F.col("g"), F.col("b"), 8.3)
    return raster_view(spark, sf_dir).select("image_id", "y", "x", *(c.alias(n) for c, n in zip(out, "rgb", strict=True)))


TONES = ", ".join(f"CAST(trunc(greatest(0.0, least(255.0, {c} * 1.2::DOUBLE + grey * -0.2::DOUBLE))) AS INT) AS s{c}, CAST(trunc(greatest(0.0, least(255.0, {c} * 1.25::DOUBLE + m{c} * (1 - 1.25::DOUBLE)))) AS INT) AS c{c}, CAST(greatest(0, least(255, {c} - 26)) AS INT) AS b{c}" for c in "rgb")


@query(f"{R}, t AS (SELECT image_id, y, x, r, g, b, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INT) AS grey, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb FROM raster WINDOW w AS (PARTITION BY image_id)) SELECT image_id, y, x, {TONES} FROM t")
def tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturation, contrast and brightness of every pixel."""
    p = raster_view(spark, sf_dir)
    means = p.groupBy("image_id").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"))
    rgb = [F.col(c) for c in "rgb"]
    groups = {"s": colour.saturated(*rgb, 0.2), "c": colour.contrasted(rgb, [F.col(f"m{c}") for c in "rgb"], 1.25), "b": colour.brightened(rgb, -26)}
    return p.join(means, "image_id").select("image_id", "y", "x", *(v.alias(f"{k}{c}") for k, own in groups.items() for c, v in zip("rgb", own, strict=True)))


@query(f"{P} SELECT image_id, y, x, round((least(0.2, greatest(-0.1, v)) + 0.1) / (0.3 + 1e-16), 6) AS place, printf('%.5f', v) AS text FROM patches")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return r6(patches(spark, sf_dir).select("image_id", "y", "x", colour.ramp(v, -0.1, 0.2).alias("place"), colour.fixed_point(v).alias("text")), "place")


@query(f"SELECT n_nationkey AS type_id, {', '.join(f'{_wheel_sql("n_nationkey / 25.0::DOUBLE * 180.0", "255.0", "255.0", n)} AS {c}' for n, c in ((5, 'r'), (3, 'g'), (1, 'b')))} FROM nation")
def colour_wheel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = colour.wheel(F.col("n_nationkey"), 25)
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("type_id"), *(c.alias(n) for c, n in zip(out, "rgb", strict=True)))


GREY = f"{R}, q AS (SELECT image_id, y, x, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INT) AS grey FROM raster)"


def greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_view(spark, sf_dir).select("image_id", "y", "x", colour.grey(F.col("r"), F.col("g"), F.col("b")).alias("grey"))


DARK = f"""{GREY}, c AS (SELECT image_id, grey, count(*) AS n FROM q GROUP BY ALL), s AS (SELECT t.image_id, t.grey, sum(c.n) FILTER (WHERE c.grey <= t.grey)::DOUBLE AS d, sum(c.n * c.grey) FILTER (WHERE c.grey <= t.grey)::DOUBLE AS dm, sum(c.n) FILTER (WHERE c.grey > t.grey)::DOUBLE AS l, sum(c.n * c.grey) FILTER (WHERE c.grey > t.grey)::DOUBLE AS lm FROM c t JOIN c ON c.image_id = t.image_id GROUP BY ALL),
    v AS (SELECT image_id, grey, row_number() OVER (PARTITION BY image_id ORDER BY round(coalesce(d * l * (dm / d - lm / nullif(l, 0)) * (dm / d - lm / nullif(l, 0)), 0), 3) DESC, grey) AS k FROM s),
    dark AS (SELECT q.image_id, q.y, q.x FROM q JOIN v ON v.image_id = q.image_id AND k = 1 WHERE q.grey <= v.grey)"""


@query(f"{DARK} SELECT * FROM dark")
def dark_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.binary(greys(spark, sf_dir))


@query()
def tissue_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = greys(spark, sf_dir)
    return tissue.tissue_mask(g, g.select("image_id").distinct().select("image_id", F.lit(20).alias("height"), F.lit(20).alias("width")), 8, 6, 1)


def _parts_sql(near: str) -> str:
    """Places of `dark` that steps within it join, by the first in reading order, and the size of their part."""
    return f"""link AS (SELECT a.image_id, a.y * 20 + a.x AS p, b.y * 20 + b.x AS q FROM dark a JOIN dark b ON b.image_id = a.image_id AND {near}),
    reach AS (SELECT image_id, y * 20 + x AS p, y * 20 + x AS q FROM dark UNION SELECT r.image_id, r.p, l.q FROM reach r JOIN link l ON l.image_id = r.image_id AND l.p = r.q),
    first AS (SELECT image_id, p, min(q) AS f, count(*) AS n FROM reach GROUP BY ALL)"""


CLOSE, ROUND = "abs(a.y - b.y) + abs(a.x - b.x) = 1", "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"


@query(f"{DARK.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_parts_sql(CLOSE)} SELECT image_id, CAST(p // 20 AS INT) AS y, CAST(p % 20 AS INT) AS x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY f) AS INT) AS inst_id FROM first")
def connected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.connected_parts(tissue.binary(greys(spark, sf_dir)))


@query(f"{DARK.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_parts_sql(ROUND)} SELECT image_id, CAST(p // 20 AS INT) AS y, CAST(p % 20 AS INT) AS x FROM first WHERE n >= 6")
def remove_small_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.remove_small_parts(tissue.binary(greys(spark, sf_dir)), 6, diagonal=True)


@query(f"{DARK.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_parts_sql(CLOSE)} SELECT image_id, CAST(p // 20 AS INT) AS y, CAST(p % 20 AS INT) AS x FROM first WHERE n >= 6")
def remove_small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.remove_small_parts(tissue.binary(greys(spark, sf_dir)), 6)


@query(f"{GREY} SELECT image_id, y, x FROM q WHERE grey > 0")
def given_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.given_mask(greys(spark, sf_dir))


WINDOWS = f"{R}, i AS (SELECT image_id FROM raster GROUP BY image_id HAVING count(*) = 400), k(o) AS (VALUES (0), (6), (12)), w AS (SELECT image_id, a.o AS y0, b.o AS x0, row_number() OVER (PARTITION BY image_id ORDER BY a.o, b.o) - 1 AS patch FROM i, k a, k b)"


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 in steps of 6 over the whole images."""
    pixels = raster_view(spark, sf_dir)
    whole = pixels.groupBy("image_id").count().where("count = 400").select("image_id", F.lit(20).alias("height"), F.lit(20).alias("width"))
    windows = grid.extract(whole, 8, 6, "Valid").select("image_id", "y", "x")
    return images.patch_pixels(pixels.select("image_id", "y", "x", "r", "g", "b", F.col("true_id").alias("inst_id")), windows, 8)


@query(f"""{WINDOWS} SELECT w.image_id, CAST(patch AS INT) AS patch, p.image_id || printf('_%03d', patch) AS name, count(*) AS pixels, CAST(sum(r * (1 + (y - y0) * 8 + x - x0)) AS BIGINT) AS rs, CAST(sum(true_id * (1 + (y - y0) * 8 + x - x0)) AS BIGINT) AS ids
    FROM w JOIN raster p ON p.image_id = w.image_id AND y >= y0 AND y < y0 + 8 AND x >= x0 AND x < x0 + 8 GROUP BY ALL""")
def patch_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches as arrays of colours and labels; sums that depend on every place of every channel stand for them."""
    p = images.patch_arrays(cut(spark, sf_dir), 8, ["r", "g", "b", "inst_id"])
    total = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda s, i: s + F.element_at("data", i * 4 + k + 1) * (i + 1))
    return p.select("image_id", "patch", F.format_string("%s_%03d", F.col("image_id").cast("string"), F.col("patch")).alias("name"), (F.size("data") / 4).cast("bigint").alias("pixels"), total(0).alias("rs"), total(3).alias("ids"))


@query(f"""{WINDOWS} SELECT count(*) AS pixels, CAST(sum(r * (y - y0 - 2) + g * (x - x0 - 2) + b) AS BIGINT) AS mixed, count(*) FILTER (WHERE true_id > 0) AS np
    FROM w JOIN raster p ON p.image_id = w.image_id AND y >= y0 + 2 AND y < y0 + 6 AND x >= x0 + 2 AND x < x0 + 6""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both inputs of training from all patches, summed up."""
    colours, targets = images.training_rows(cut(spark, sf_dir), 8, 4, min_size=1)
    both = colours.select(F.lit(1).alias("pixel"), (F.col("r") * F.col("y") + F.col("g") * F.col("x") + F.col("b")).alias("mixed")).unionByName(targets.select("np"), allowMissingColumns=True)
    return both.agg(F.sum("pixel").alias("pixels"), F.sum("mixed").alias("mixed"), F.sum("np").alias("np"))


@query(f"{LAB}, o AS (SELECT image_id, inst_id, avg(x) AS cx, avg(y) AS cy, max(type_id) AS k FROM lab GROUP BY ALL) SELECT image_id, inst_id AS inst_uid, round(cx, 6) AS cx, round(cy, 6) AS cy, k AS inst_type FROM o")
def tile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raster_view(spark, sf_dir).where("true_id > 0").select("image_id", "y", "x", F.col("true_id").alias("inst_id"), "type_id")
    kinds = t.groupBy("image_id", "inst_id").agg(F.max("type_id").alias("type"))
    objects = instances.boxes(t).join(kinds, ["image_id", "inst_id"]).withColumn("centroid", F.array("cx", "cy"))
    out = images.tile_table(objects)
    return r6(out.select("image_id", "inst_uid", F.col("inst_centroid")[0].alias("cx"), F.col("inst_centroid")[1].alias("cy"), "inst_type"), "cx", "cy")


@query("SELECT s_suppkey AS image_id FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9)")
def not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), "s_nationkey")
    return documents.not_done(s.select("image_id"), s.where("s_nationkey < 9").select("image_id"))


@query(f"{LAB} SELECT image_id, y, x, inst_id FROM lab WHERE NOT (inst_id % 3 = 0 AND image_id % 2 = 0)")
def remove_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = truth(spark, sf_dir)
    return instances.without(t, t.where("inst_id % 3 = 0 and image_id % 2 = 0").select("image_id", "inst_id").distinct())


@query(f"{LAB}, k AS (SELECT CAST(type_id AS INT) AS type_id, count(*) AS pixels FROM lab GROUP BY ALL) SELECT CAST(i AS INT) AS type_id, CAST(i AS VARCHAR) AS name, CAST(floor(255 * (0.0416 + 0.9584 * i / 255 / 0.365079)) AS INT) AS r, 0 AS g, 0 AS b, coalesce(pixels, 0) AS pixels FROM range(6) t(i) LEFT JOIN k ON k.type_id = i")
def default_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of every type that a dictionary by number names, also of those that no pixel has."""
    counts = raster_view(spark, sf_dir).where("true_id > 0").groupBy("type_id").agg(F.count(F.lit(1)).alias("pixels"))
    return documents.checked_types(documents.default_types(spark, 6), 6).join(counts, "type_id", "left").fillna(0, ["pixels"])


@query(f"{R} SELECT image_id, y, x, CAST(r / 255.0::DOUBLE >= 0.2 AS INT) AS inferred, CAST(r / 255.0::DOUBLE > 0.2 AS INT) AS validated, CAST(true_id > 0 AS INT) AS label FROM raster")
def binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground of shares: at the threshold it counts in inference, and not in validation."""
    share = F.col("r") / 255.0
    return raster_view(spark, sf_dir).select("image_id", "y", "x", scalar.foreground(share, 0.2).alias("inferred"), scalar.foreground(share, 0.2, strict=True).alias("validated"), scalar.foreground(F.col("true_id"), 0, strict=True).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN k ELSE CASE WHEN k = 'b' THEN k ELSE 'module.' || k END END AS name, i AS value FROM part, (VALUES ('a', 1), ('b', 2), ('c', 3)) t(k, i)")
def stripped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parameters without their prefix, where all have it."""
    name = lambda k: F.when((F.col("p_partkey") % 3 == 0) & F.lit(k == "b"), k).otherwise(f"module.{k}")
    params = F.map_from_arrays(F.array(*(name(k) for k in "abc")), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return read(spark, sf_dir, "part").select("p_partkey", params.alias("p")).select("p_partkey", F.explode(documents.stripped_keys(F.col("p"))).alias("name", "value"))


@query("SELECT p_partkey, CAST(p_partkey // 7 * 7 AS DOUBLE) AS m, '[[]' || p_partkey || ']' AS escaped FROM part")
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", scalar.round_to_multiple(key, 7).cast("double").alias("m"), scalar.escaped_glob(F.concat(F.lit("["), key.cast("string"), F.lit("]"))).alias("escaped"))


WHOLE = "i AS (SELECT image_id FROM raster GROUP BY image_id HAVING count(*) = 400)"


@query(f"{R}, {WHOLE} SELECT image_id, y, x, r / 255.0::DOUBLE AS np, CAST(b AS DOUBLE) AS v FROM raster JOIN i USING (image_id)")
def tile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of padded images through a predictor that hands back what its centre shows, put together again."""
    import pandas as pd

    shapes = runs.Shapes(14, 6)
    pixels = raster_view(spark, sf_dir).select("image_id", "y", "x", "r", "g", "b")
    sizes = pixels.groupBy("image_id").count().where("count = 400").select("image_id", F.lit(20).alias("height"), F.lit(20).alias("width"))

    def centre(batch: pd.DataFrame) -> pd.Series:
        cut = [d.reshape(14, 14, 3)[4:10, 4:10] / [255.0, 1.0, 1.0] for d in batch["data"]]
        return pd.Series([c.ravel() for c in cut], index=batch.index)

    return runs.tile_maps(runs.tile_inputs(pixels, sizes, shapes), centre, sizes, shapes).select("image_id", "y", "x", "np", "v")
