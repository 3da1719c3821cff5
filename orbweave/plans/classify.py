"""Per-pixel classification: sample under polygons, fit a forest, predict, smooth, and report on the samples held out.

A model is a Spark transformer that turns `features` into `probability` or `prediction`, or any Python object with predict(rows) and classes_ (and predict_proba, if
it has it), pickled into one file. train_rf saves its forest with a side-car of what prediction and the report need: the classes' names, the bands, the grid,
band statistics and the held-out samples.
"""

from __future__ import annotations

import json
import logging
import os
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest as T
from ..operators import raster as R
from ..operators import samples as A
from ..operators import smoothing as M
from ..sources import raster as files
from ..sources import vector

log = logging.getLogger("orbweave.classify")


def fit(samples: DataFrame, trees: int = 500, depth: int | None = None, seed: int = 42) -> T.Forest | PipelineModel:
    """A random forest over features (ARRAY) and label; the square root of the features at each node. Samples too large for a task are Spark's own forest's, up to 30 deep."""
    width = samples.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("k")).first()
    if width["n"] * (width["k"] or 0) <= T.MOST:
        return T.fit(samples, trees, depth, seed)
    rows = samples.select("label", array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("features"))
    index = StringIndexer(inputCol="label", outputCol="indexed", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(featuresCol="features", labelCol="indexed", numTrees=trees, maxDepth=min(30, depth or 30), featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[index, forest, IndexToString(inputCol="prediction", outputCol="class_text", labels=index.labels)]).fit(rows)


def _stages(model) -> list:
    return list(model.stages) if isinstance(model, PipelineModel) else [model] if isinstance(model, Transformer) else []


def classes_of(model) -> list[float]:
    """The class values in the order of the probabilities: an object's classes_, an index's labels, else 0, 1, 2 and so on."""
    if not isinstance(model, Transformer):
        return [float(x) for x in model.classes_]
    for stage in _stages(model):
        if isinstance(stage, StringIndexerModel):
            return [float(x) for x in stage.labels]
    return [float(k) for k in range(next(s.numClasses for s in _stages(model) if hasattr(s, "numClasses")))]


def importances_of(model) -> list[float] | None:
    """How much each band matters, where the model tells."""
    found = next((s.featureImportances.toArray() for s in _stages(model) if hasattr(s, "featureImportances")), getattr(model, "feature_importances_", None))
    return None if found is None else [float(x) for x in found]


def probabilities(pixels: DataFrame, model) -> DataFrame:
    """r, c, p (in the order of classes_of) of pixels with bands. A model that only predicts gives its class 1 and the others 0."""
    if not isinstance(model, Transformer):
        return _by_object(pixels, model)
    out = pixels.select("r", "c", array_to_vector(F.transform("bands", lambda x: x.cast("double"))).alias("features"))
    for stage in _stages(model):
        if not isinstance(stage, (IndexToString, StringIndexerModel)):
            out = stage.transform(out)
    if "probability" in out.columns:
        return out.select("r", "c", vector_to_array("probability").alias("p"))
    return out.select("r", "c", F.array(*[(F.col("prediction") == k).cast("double") for k in range(len(classes_of(model)))]).alias("p"))


def _by_object(pixels: DataFrame, model) -> DataFrame:
    classes = np.asarray(model.classes_)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.array(batch.column("bands").to_pylist(), float)
                p = np.asarray(model.predict_proba(rows), float) if hasattr(model, "predict_proba") else (np.asarray(model.predict(rows))[:, None] == classes).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("c"), pa.array(p.tolist(), pa.list_(pa.float64()))], ["r", "c", "p"])

    if getattr(model, "heavy", False):
        pixels = pixels.repartition(4 * pixels.sparkSession.sparkContext.defaultParallelism)
    return pixels.select("r", "c", "bands").mapInArrow(judge, ", ".join(f"{c} {t}" for c, t in pixels.select("r", "c").dtypes) + ", p array<double>")


def predicted(pixels: DataFrame, model) -> DataFrame:
    """r, c, class."""
    return R.class_raster(probabilities(pixels, model), classes_of(model), F.lit(True))


def open_stack(spark: SparkSession, paths: str | Sequence[str], bands: Sequence[int] | None = None) -> tuple[DataFrame, R.Grid, list[float | None]]:
    """The rasters' bands on the first one's grid, the grid, and each band's nodata value."""
    tables, nodata, total = [], [], 0
    for path in files.expand(paths):
        h = files.header(path)
        pixels, grid = files.read(spark, path)
        if tables:
            pixels = R.align(pixels, grid, template).filter("bands IS NOT NULL")
        else:
            template = grid
        tables.append(pixels)
        nodata += R.nodata_list(grid.nodata, h.bands)
        total += h.bands
    wanted = R.band_list(bands, total)
    return R.stack(tables, wanted, total), template, [nodata[b - 1] for b in wanted]


def training_samples(spark: SparkSession, pixels: DataFrame, grid: R.Grid, nodata: Sequence[float | None], labels_path: str, label_column: str) -> tuple[DataFrame, dict[int, str]]:
    """Samples of all labelled polygons in feature order, and the name of each class code. Labels that are whole numbers are their own codes."""
    found, crs = vector.features(labels_path)
    if not any(label_column in more for _, more in found):
        raise ValueError(f"Column '{label_column}' not found in labels.")
    if crs is None:
        log.warning("The labels have no CRS; the raster's is taken.")
    values = [more.get(label_column) for _, more in found]
    names: dict[int, str] = {}
    if all(v is None or isinstance(v, int) for v in values):
        codes = values
    else:
        texts = spark.createDataFrame([(None if v is None else str(v),) for v in values], "value string")
        ranks = {r["value"]: r["code"] for r in A.category_codes(texts, "value").orderBy("code").collect()}  # a row for each class
        codes = [None if v is None else ranks[str(v)] for v in values]
        names = {k: v for v, k in ranks.items()}
    rows = []
    for k, ((g, more), code) in enumerate(zip(found, codes, strict=True)):
        if crs and grid.crs:
            g = g.project(crs, grid.crs)
        rows.append((k, code, None if g.empty else json.dumps(g.to_json()), str(more.get("id", more.get("fid", k)))))
    polygons = spark.createDataFrame(rows, "fid long, label int, geometry string, source_id string")
    cells = R.rasterized(polygons, grid).join(F.broadcast(polygons.select("fid", "source_id")), "fid")  # as many rows as the label file has features
    valid = pixels.filter(~R.is_nodata(F.col("bands"), nodata))
    out = cells.join(valid, ["r", "c"]).select("fid", "label", "r", "c", "source_id", F.col("bands").alias("features"))
    ordered = out.withColumn("ord", F.col("fid") * (grid.width * grid.height) + F.col("r").cast("long") * grid.width + F.col("c"))
    return ordered.drop("fid"), names


def train_rf(
    image_path: str | Sequence[str],
    labels_path: str,
    label_column: str,
    model_out: str,
    n_estimators: int = 500,
    max_depth: int | None = None,
    n_jobs: int = -1,
    random_state: int = 42,
    test_fraction: float = 0.3,
    grid_size: int | None = None,
    band_indices: Sequence[int] | None = None,
    *,
    spark: SparkSession,
) -> T.Forest | PipelineModel:
    """Fit and save a forest. model_out becomes a folder: model, and side-car tables holdout, band_stats, points, and meta.json; beside it go
    the layers of training and held-out points.

    n_jobs is accepted and left to Spark.
    """
    if grid_size is not None and grid_size < 1:
        raise ValueError("grid_size must be >= 1.")
    pixels, grid, nodata = open_stack(spark, image_path, band_indices)
    samples, names = training_samples(spark, pixels, grid, nodata, labels_path, label_column)
    samples = A.thin(samples, grid_size or 1, seed=random_state).cache()
    if not samples.limit(1).count():
        raise ValueError("No training samples found under the labels.")
    if names:
        log.info("Label codes: %s", A.label_preview(names))
    train, test = A.split(samples, test_fraction, random_state)
    model = fit(train, n_estimators, max_depth, random_state)
    if isinstance(model, T.Forest):
        model.save(os.path.join(model_out, "model"))
    else:
        model.write().overwrite().save(os.path.join(model_out, "model"))
    A.class_band_stats(train, [int(v) for v in classes_of(model)]).write.mode("overwrite").parquet(os.path.join(model_out, "band_stats"))
    _points(train, model, grid).write.mode("overwrite").parquet(os.path.join(model_out, "points_train"))
    if test is not None:
        test.write.mode("overwrite").parquet(os.path.join(model_out, "holdout"))
        _points(test, model, grid).write.mode("overwrite").parquet(os.path.join(model_out, "points_val"))
    spark.createDataFrame([(json.dumps({"names": names, "bands": list(band_indices) if band_indices else None, "classes": classes_of(model), "width": grid.width, "height": grid.height, "transform": grid.transform, "crs": grid.crs, "grid_size": grid_size, "holdout": test is not None}),)], "meta string").write.mode("overwrite").text(os.path.join(model_out, "meta"))
    samples.unpersist()
    export_points(spark, model_out, grid.crs)
    return model


def _points(samples: DataFrame, model, grid: R.Grid) -> DataFrame:
    """A point for each sample: label, prediction, source_id and the cell's centre."""
    own = samples.select("ord", "label", "source_id", "r", "c")
    rows = samples.select(F.col("ord").cast("long").alias("r"), F.lit(0).alias("c"), F.col("features").alias("bands"))
    x, y = grid.centre(F.col("r"), F.col("c"))
    return own.join(predicted(rows, model).select(F.col("r").alias("ord"), F.col("class").alias("pred")), "ord").select("ord", F.col("label").alias("truth"), "pred", "source_id", x.alias("x"), y.alias("y"))


def export_points(spark: SparkSession, model_out: str, crs: str | None) -> list[str]:
    """The training and held-out points as GeoPackage layers beside the model: <model>_train_points.gpkg and <model>_val_points.gpkg.
    Without a coordinate system there are none."""
    if crs is None:
        log.warning("The training raster has no CRS; no point layers are written.")
        return []
    out = []
    for part in ("train", "val"):
        folder = os.path.join(model_out, f"points_{part}")
        if os.path.isdir(folder):
            rows = [(r["x"], r["y"], {"truth": r["truth"], "pred": int(r["pred"]), "source_id": r["source_id"]}) for r in spark.read.parquet(folder).orderBy("ord").collect()]  # one file, on the driver
            vector.write_geopackage(f"{model_out.rstrip('/')}_{part}_points.gpkg", rows, int(crs.split(":")[1]))
            out.append(f"{model_out.rstrip('/')}_{part}_points.gpkg")
    return out


def load_model(spark: SparkSession, path: str) -> tuple:
    """A model and what is known of it: a folder of train_rf, or one file with a pickled object (only from where code may come from, too)."""
    if os.path.isfile(path):
        with open(path, "rb") as file:
            model = pickle.load(file)  # noqa: S301
        return model, {"names": {}, "bands": None, "classes": classes_of(model), "holdout": False}
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()["value"])
    folder = os.path.join(path, "model")
    return T.Forest.load(folder) if os.path.isfile(os.path.join(folder, "forest.json")) else PipelineModel.load(folder), meta


def _checked(smooth: str, beta: float, overlap: int) -> None:
    if smooth not in ("none", "mrf", "bayes"):
        raise ValueError("smooth must be one of: none, mrf, bayes.")
    if overlap < 0:
        raise ValueError("block_overlap must be >= 0.")


def smoothed(probs: DataFrame, grid: R.Grid, classes: Sequence[float], smooth: str = "none", beta: float = 1.0, neighborhood: int = 4, icm_iters: int = 3, bayes_window_size: int = 7, bayes_neigh_fraction: float = 0.5, bayes_smoothness: float | Sequence[float] = 20.0, block_shape: tuple[int, int] | None = None, block_overlap: int | None = None, stored: bool = False) -> DataFrame:
    """r, c, class of probabilities (r, c, p, valid). Without block_shape the result is that of the whole raster at once; with it,
    blocks see block_overlap cells (0 if not given) beyond their border and no more."""
    overlap = (block_overlap or 0) if block_shape else None
    shape = block_shape or M.BLOCK
    values = [*classes]
    if smooth == "mrf":
        label = M.icm_smooth(probs, grid.width, grid.height, beta, neighborhood, icm_iters, 1e-9, stored, shape, overlap)
        table = F.array(*map(F.lit, values))
        return label.select("r", "c", F.when(F.col("label") >= 0, F.get(table, F.col("label"))).otherwise(F.lit(-1.0)).alias("class"))
    if smooth == "bayes":
        found = M.bayes_smooth(probs, grid.width, grid.height, len(values), bayes_window_size, bayes_neigh_fraction, bayes_smoothness, shape, overlap)
        probs = found.join(probs.select("r", "c", "valid"), ["r", "c"])
    return R.class_raster(probs, values, F.col("valid"))


def predict_rf(
    image_path: str | Sequence[str],
    model_path: str,
    output_path: str,
    probs_out: str | None = None,
    binary_out: str | None = None,
    block_shape: tuple[int, int] | None = None,
    band_indices: Sequence[int] | None = None,
    smooth: str = "none",
    block_overlap: int | None = None,
    jobs: int = 1,
    *,
    spark: SparkSession,
    **smoothing,
) -> str:
    """Write the class raster, and if asked for the probabilities and a 0/1 raster for each class, and a report on the held-out samples."""
    _checked(smooth, smoothing.get("beta", 1.0), block_overlap or 0)
    model, meta = load_model(spark, model_path)
    pixels, grid, nodata = open_stack(spark, image_path, band_indices or meta["bands"])
    classes = classes_of(model)
    valid = ~R.is_nodata(F.col("bands"), nodata)
    probs = probabilities(pixels, model).join(pixels.select("r", "c", valid.alias("valid")), ["r", "c"]).cache()
    if probs_out:
        wide = probs.select("r", "c", *[F.when(F.col("valid"), F.element_at("p", k + 1)).otherwise(float("nan")).alias(f"p{k}") for k in range(len(classes))])
        _write(wide, probs_out, R.Grid(grid.width, grid.height, grid.transform, grid.crs, (float("nan"),)), [f"p{k}" for k in range(len(classes))], "float32")
    out = smoothed(probs, grid, classes, smooth, block_shape=block_shape, block_overlap=block_overlap, **smoothing).cache()
    path = write_classes(out, output_path, grid, classes, binary_out)
    if meta["holdout"]:
        report(spark, model, meta, model_path, out, grid, smooth, metrics_path(path))
    probs.unpersist()
    out.unpersist()
    return path


def smooth_probs(probs_path: str, output_path: str, model_path: str | None = None, class_values: Sequence[float] | None = None, block_shape: tuple[int, int] | None = None, smooth: str = "mrf", block_overlap: int | None = None, jobs: int = 1, *, spark: SparkSession, **smoothing) -> str:
    """The same smoothing of a stored probability raster; its classes come from a model or are given."""
    _checked(smooth, smoothing.get("beta", 1.0), block_overlap or 0)
    if (model_path is None) == (class_values is None):
        raise ValueError("Provide exactly one of model_path or class_values.")
    classes = [float(v) for v in class_values] if class_values is not None else load_model(spark, model_path)[1]["classes"]
    h = files.header(probs_path)
    if h.bands < 1 or h.bands != len(classes):
        raise ValueError(f"Probability raster has {h.bands} bands but there are {len(classes)} classes.")
    pixels, grid = files.read(spark, probs_path)
    valid = R.finite(F.col("bands")) & ~R.is_nodata(F.col("bands"), R.nodata_list(grid.nodata, h.bands))
    out = smoothed(pixels.select("r", "c", F.col("bands").alias("p"), valid.alias("valid")), grid, classes, smooth, block_shape=block_shape, block_overlap=block_overlap, stored=True, **smoothing)
    return write_classes(out, output_path, grid, classes)


def write_classes(out: DataFrame, path: str, grid: R.Grid, classes: Sequence[float], binary_out: str | None = None) -> str:
    """Integer classes as int16 with nodata -1, others as float32 with NaN; a .vrt name becomes .tif."""
    whole = all(float(v).is_integer() for v in classes)
    fill = -1.0 if whole else float("nan")
    path = os.path.splitext(path)[0] + ".tif" if path.lower().endswith(".vrt") else path
    _write(out, path, R.Grid(grid.width, grid.height, grid.transform, grid.crs, (fill,)), ["class"], "int16" if whole else "float32")
    if binary_out:
        masks = R.binary_masks(out, classes)
        for v in classes:
            _write(masks, os.path.join(binary_out, f"class_{v:g}.tif"), R.Grid(grid.width, grid.height, grid.transform, grid.crs, (0,)), [f"class_{v:g}"], "uint8")
    return path


def _write(pixels: DataFrame, path: str, grid: R.Grid, columns: list[str], dtype: str) -> None:
    if path.lower().endswith((".tif", ".tiff")):
        files.write(pixels, path, grid, columns, dtype)
    else:
        pixels.select("r", "c", *columns).write.mode("overwrite").parquet(path)


def metrics_path(path: str) -> str:
    return os.path.splitext(path)[0] + "_metrics.txt"


def layout(labels: Sequence, matrix: np.ndarray) -> str:
    """A confusion matrix as text: every entry as wide as the widest label or number."""
    cells = [[*map(str, labels)], *(list(map(str, row)) for row in matrix.tolist())]
    width = max([1, *(len(x) for row in cells for x in row)])
    side = ["", *map(str, labels)]
    return "\n".join(" ".join(x.rjust(width) for x in [name, *row]) for name, row in zip(side, cells, strict=True))


def report(spark: SparkSession, model, meta: dict, model_path: str, raster: DataFrame, grid: R.Grid, smooth: str, path: str) -> None:
    """Held-out accuracy, confusion matrix, wrong sources, importances and band statistics as text; after smoothing also what the
    smoothed raster says at the samples, if it is on their grid."""
    held = spark.read.parquet(os.path.join(model_path, "holdout"))
    labels = [int(v) if float(v).is_integer() else v for v in meta["classes"]]
    names = {int(k): v for k, v in meta["names"].items()}
    shown = [str(names.get(v, v)) for v in labels]
    rows = held.select(F.col("ord").cast("long").alias("r"), F.lit(0).alias("c"), F.col("features").alias("bands"))
    pred = held.join(predicted(rows, model).select(F.col("r").alias("ord"), "class"), "ord").select(F.col("label").alias("truth"), F.col("class").cast("int").alias("pred"), "source_id").cache()
    accuracy, matrix, wrong = _measured(pred, labels)
    thinned = meta.get("grid_size")
    lines = [
        f"Holdout samples: {pred.count()}",
        f"Raw accuracy: {accuracy:.3f}",
        f"Training grid sampling: {thinned} px per cell." if thinned else "Training grid sampling: none.",
        "",
        "Raw confusion matrix (rows=true, cols=pred):",
        layout(shown, matrix),
        "",
        f"Misclassified validation IDs (raw): {_named(wrong)}",
        "",
        f"Smoothing mode: {smooth}",
    ]
    on_grid = (meta["width"], meta["height"], meta["crs"]) == (grid.width, grid.height, grid.crs) and np.allclose(meta["transform"], grid.transform)
    pairs = lost = None
    if smooth != "none" and on_grid:
        pairs, lost = A.at_samples(held, raster.select("r", "c", F.col("class").cast("int").alias("class")), grid.width, grid.height)
    if pairs is None or not pairs.limit(1).count():
        note = None if smooth == "none" else "raster grid differs from the training grid." if not on_grid else "no sample lies on a class."
        lines += ["Smoothed accuracy: unavailable.", *([f"Smoothed metrics note: {note}"] if note else []), "", "Smoothed confusion matrix: unavailable."]
    else:
        accuracy, matrix, wrong = _measured(pairs, labels)
        lines += [f"Smoothed accuracy: {accuracy:.3f}", "", "Smoothed confusion matrix (rows=true, cols=pred):", layout(shown, matrix)]
        n = lost.first()
        if n["outside"] or n["nodata"]:
            lines.append(f"Dropped {n['outside'] + n['nodata']} holdout samples outside raster or on nodata.")
        lines += ["", f"Misclassified validation IDs (smoothed): {_named(wrong)}"]
    importances = importances_of(model)
    bands = meta["bands"] or list(range(1, len(held.select("features").first()["features"]) + 1))
    if importances is None:
        lines += ["", "Band importance unavailable (model has no feature_importances_)."]
    else:
        lines += ["", "Band importance (sorted):", *(f"band {bands[k]}: {importances[k]:.6f}" for k in np.argsort(-np.array(importances), kind="stable"))]
    stats: dict[int, list] = {}
    for r in spark.read.parquet(os.path.join(model_path, "band_stats")).orderBy("label", "band").collect():  # a row for each class and band
        stats.setdefault(r["label"], []).append(r)
    lines += ["", "Per-class band stats (train):"]
    for label, name in zip(labels, shown, strict=True):
        own = stats.get(label, [])
        lines.append(f"class {name} (n={own[0]['n'] if own else 0}):")
        value = lambda x: float("nan") if x is None else x
        lines += [f"band {bands[r['band'] - 1]}: mean={value(r['mean']):.6f} std={value(r['std']):.6f}" for r in own] or [f"band {b}: mean=nan std=nan" for b in bands]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")
    pred.unpersist()


def _named(wrong: list[str] | None) -> str:
    """What the report says of samples without ids, and of none."""
    return "unavailable." if wrong is None else ", ".join(wrong) or "none"


def _measured(pairs: DataFrame, labels: list) -> tuple[float, np.ndarray, list[str] | None]:
    found = {r["truth"]: r for r in A.confusion(pairs, labels).collect()}  # a row for each class
    matrix = np.array([[found[t][f"pred_{p}"] for p in labels] for t in labels])
    known = pairs.filter("source_id IS NOT NULL").limit(1).count() > 0
    return A.accuracy(pairs).first()["accuracy"] or 0.0, matrix, A.misclassified(pairs).first()["source_ids"] if known else None


def distance_to_vector(vector_path: str, template_path: str, output_path: str, backend: str = "cpu", *, spark: SparkSession) -> str:
    """The distance from each cell of a template raster to the nearest feature cell, as float32."""
    if backend not in ("cpu", "gpu"):
        raise ValueError("backend must be 'cpu' or 'gpu'.")
    if backend == "gpu":
        raise ImportError("There is no GPU backend.")
    h = files.header(template_path)
    grid = h.grid
    if grid.crs is None:
        raise ValueError("The template has no CRS.")
    if h.geographic:
        raise ValueError("The template's CRS must be projected.")
    if grid.transform[1] or grid.transform[3]:
        raise ValueError("Distance needs a grid without rotation or shear.")
    found, crs = vector.features(vector_path)
    if found and crs is None:
        raise ValueError("The vector file has no CRS.")
    rows = [(k, 1, json.dumps(g.project(crs, grid.crs).to_json())) for k, (g, _) in enumerate(found) if not g.empty]
    if not rows:
        raise ValueError(f"No geometries found in '{vector_path}'.")
    cells = R.rasterized(spark.createDataFrame(rows, "fid long, label int, geometry string"), grid)
    _write(R.distance(cells, grid), output_path, R.Grid(grid.width, grid.height, grid.transform, grid.crs), ["distance"], "float32")
    return output_path


