"""Names of layers, files, labels and images as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How layer names tell what a layer is.
DENSE_PREFIXES = ["dlc_", "dlccorr", "lk_", "deblip"]
DENSE_PARTS = ["lkmovavg"]
DERIVED_PREFIXES = ["dlc", "lk_", "blips", "deblip"]
SPECIAL_NAMES = ["dlccorr", "buffer"]
ANNOTATIONS = "_annotations"
TRACE_MARK = "DLC"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), r"[\\/]"), -1)


def folder(path: str | Column) -> Column:
    return F.regexp_replace(_col(path), r"[\\/]?[^\\/]*$", "")


def stem(path: str | Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: str | Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1)


def video_name(path: str | Column) -> Column:
    """The video part of an annotation file name."""
    return F.element_at(F.split(stem(path), ANNOTATIONS), 1)


def trace_video(path: str | Column) -> Column:
    """The video part of a trace file name."""
    return F.regexp_extract(stem(path), f"^(.*?){TRACE_MARK}", 1)


def layer_name(path: str | Column) -> Column:
    """The layer a file holds, from its path."""
    s = stem(path)
    tail = F.regexp_replace(F.element_at(F.split(s, ANNOTATIONS), -1), r"\.json$", "")
    parent = F.element_at(F.split(_col(path), r"[\\/]"), -2)
    return (
        F.when(F.contains(s, F.lit(ANNOTATIONS)), F.trim(tail, F.lit("_")))
        .when(
            F.contains(s, F.lit(TRACE_MARK)),
            F.concat(F.lit("dlc_"), parent, F.lit("_"), F.element_at(F.split(s, "_"), -1)),
        )
        .otherwise(s)
    )


def is_dense(layer: str | Column) -> Column:
    """Does the layer hold a point for nearly every frame?"""
    layer = _col(layer)
    return _any(
        [F.startswith(layer, F.lit(p)) for p in DENSE_PREFIXES]
        + [F.contains(layer, F.lit(p)) for p in DENSE_PARTS]
    )


def is_manual(layer: str | Column, path: str | Column | None = None, video_path: str | Column | None = None) -> Column:
    """Is the layer made by hand? With paths, the file must also sit beside its video."""
    layer = _col(layer)
    named = ~layer.isin(SPECIAL_NAMES) & ~_any([F.startswith(layer, F.lit(p)) for p in DERIVED_PREFIXES])
    if path is None:
        return named
    base = F.concat(stem(video_path), F.lit(ANNOTATIONS))
    matches = (stem(path) == base) | F.startswith(stem(path), F.concat(base, F.lit("_")))
    filed = (suffix(path) == ".json") & (folder(path) == folder(video_path)) & matches
    return F.coalesce(filed, F.lit(False)) & named


def layer_path(video_path: str | Column, layer: str | Column) -> Column:
    """Where a layer of a video is stored."""
    layer = _col(layer)
    where = folder(video_path)
    name = F.concat(
        stem(video_path), F.lit(ANNOTATIONS), F.when(layer == "", "").otherwise(F.concat(F.lit("_"), layer)), F.lit(".json")
    )
    return F.when(where == "", name).otherwise(F.concat(where, F.lit("/"), name))


def label_from_bodypart(
    df: DataFrame, *, file: str = "file", bodypart: str = "bodypart", pos: str | None = None, mode: str = "trace"
) -> DataFrame:
    """Add the label of each body part of a file.

    If every part is ``point<digits>`` (or digits), labels are the digits.
    Otherwise they count from 0: in text order (``trace``) or in list order
    given by ``pos`` (``config``). ``strip`` only removes the prefix.
    """
    bare = F.regexp_replace(F.col(bodypart), "^point", "")
    if mode == "strip":
        return df.withColumn("label", bare)
    if mode not in ("trace", "config"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "config" and pos is None:
        raise ValueError("mode 'config' needs the list position")
    # Few body parts exist per file, whatever the number of points.
    names = df.select(file, bodypart, *([pos] if mode == "config" else [])).distinct()
    rank = F.dense_rank().over(Window.partitionBy(file).orderBy(pos if mode == "config" else bodypart)) - 1
    digits = F.bool_and(bare.rlike("^[0-9]+$")).over(Window.partitionBy(file))
    named = names.select(file, bodypart, F.when(digits, bare).otherwise(rank.cast("string")).alias("label"))
    return df.join(named, [file, bodypart])


def rebase_path(config: str | Column, old: str | Column) -> Column:
    """Re-root a path at the project folder that ``config`` lies in.

    Cuts after the last segment equal to the folder (then: equal ignoring
    case). A struct of the new path (NULL on failure) and a status.
    """
    config, old = _col(config), _col(old)
    is_file = F.lower(file_name(config)) == "config.yaml"
    root = F.when(is_file, folder(config)).otherwise(F.regexp_replace(config, r"[\\/]+$", ""))
    project = file_name(root)
    windows = F.contains(config, F.lit("\\")) | config.rlike("^[A-Za-z]:")
    sep = F.when(windows, F.lit("\\")).otherwise(F.lit("/"))
    parts = F.filter(F.split(F.trim(old), r"[\\/]+"), lambda p: p != "")
    back = F.reverse(parts)
    exact = F.array_position(back, project)
    loose = F.array_position(F.transform(back, lambda p: F.lower(p)), F.lower(project))
    from_end = F.when(exact > 0, exact).otherwise(loose).cast("int")
    tail = F.when(from_end > 1, F.slice(back, F.lit(1), from_end - 1))
    path = F.when(from_end == 1, root).otherwise(
        F.concat(F.regexp_replace(root, r"[\\/]+$", ""), sep, F.array_join(F.reverse(tail), "\u0000"))
    )
    path = F.replace(path, F.lit("\u0000"), sep)
    status = (
        F.when(F.coalesce(project, F.lit("")) == "", "no_project_folder")
        .when(from_end == 0, "folder_not_found")
        .otherwise("ok")
    )
    return F.struct(F.when(status == "ok", path).alias("path"), status.alias("status"))


def image_name(frame: str | Column, n_frames: str | Column | None = None, *, width: int | None = None) -> Column:
    """``img<frame>.png``, padded to the digits of the frame count or a fixed width."""
    text = _col(frame).cast("string")
    digits = F.lit(width) if width is not None else F.length(_col(n_frames).cast("string"))
    # lpad would cut longer numbers.
    padded = F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, F.lit("0")))
    return F.concat(F.lit("img"), padded, F.lit(".png"))


def frame_of_image(image: str | Column) -> Column:
    return F.regexp_extract(_col(image), r"img([0-9]+)\.png$", 1).try_cast("long")


def layer_group(layer: str | Column) -> Column:
    """Sort key of the layer groups; keep the load order inside a group."""
    layer = _col(layer)
    return (
        F.when(layer == "buffer", 5)
        .when(layer == "labeled_data", 2)
        .when(F.startswith(layer, F.lit("dlccorr")), 4)
        .when(F.startswith(layer, F.lit("dlc_")), 3)
        .when(F.endswith(layer, F.lit("_manual_corrections")), 1)
        .otherwise(0)
    )


def video_index(project_videos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Position of the first project video with the same file stem; NULL if none.

    ``project_videos(path, pos)``, ``wanted(path)``.
    """
    known = project_videos.groupBy(stem("path").alias("_stem")).agg(F.min("pos").alias("pos"))
    return wanted.withColumn("_stem", stem("path")).join(known, "_stem", "left").drop("_stem")


def trace_number(path: str | Column) -> Column:
    """Training iterations of a trace file: the number after the last underscore."""
    return F.regexp_extract(stem(path), r"_([0-9]+)$", 1).try_cast("long")


def latest_trace(files: DataFrame, iteration: int | None = None) -> DataFrame:
    """The trace file of each video with the highest, or the given, training number; of several the last path."""
    numbered = files.withColumn("n", trace_number("path")).where(F.col("n").isNotNull())
    if iteration is not None:
        numbered = numbered.where(F.col("n") == iteration)
    best = numbered.groupBy("video").agg(F.max_by("path", F.struct("n", "path")).alias("path"), F.max("n").alias("n"))
    return best
