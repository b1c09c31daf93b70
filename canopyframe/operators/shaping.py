"""Dataset shaping: padding, splits, window sampling and augmentation, all repeatable per seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyframe.operators.grid import tile_pixels
from canopyframe.operators.ordered import chunked, last_seen, ordinal, prefix_sum


def uniform(*parts: Column) -> Column:
    """A repeatable draw in [0, 1) from a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def normal(*parts: Column) -> Column:
    """A repeatable standard normal draw (Box-Muller on two hash draws)."""
    u, v = uniform(F.lit("u"), *parts), uniform(F.lit("v"), *parts)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def concat_windows(*parts: DataFrame) -> DataFrame:
    """Union of window tables by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def covered_windows(tiles: DataFrame, min_frac: float, size: int) -> DataFrame:
    """Windows whose labelled and valid share of size*size pixels reaches ``min_frac``.

    ``tiles`` has one row per (window, pixel) with ``labelled`` and ``valid``.
    """
    share = F.count_if(F.col("labelled") & F.col("valid")) / F.lit(size * size)
    return tiles.groupBy("scene_id", "row_off", "col_off").agg(share.alias("coverage")).filter(F.col("coverage") >= min_frac)


def pad_scenes(px: DataFrame, sizes: DataFrame, size: int, bands: int | None = None) -> DataFrame:
    """Scenes smaller than a window grown to it with 0 spectra, class -1, onset 30, invalid.

    Only the missing border cells are generated; existing pixels pass through untouched. The
    table of small scenes is bounded by size*size pixels each.
    """
    s = sizes.filter((F.col("height") < size) | (F.col("width") < size))
    full = s.withColumn("row", F.explode(F.sequence(F.lit(0), F.greatest(F.col("height"), F.lit(size)) - 1)))
    full = full.withColumn("col", F.explode(F.sequence(F.lit(0), F.greatest(F.col("width"), F.lit(size)) - 1)))
    border = full.filter((F.col("row") >= F.col("height")) | (F.col("col") >= F.col("width"))).select("scene_id", "row", "col")
    fill = {"cls": F.lit(-1), "onset": F.lit(30.0), "valid": F.lit(False)}
    if bands is not None:
        fill["spectrum"] = F.array_repeat(F.lit(0.0), bands)
    names = [c for c in px.columns if c in ("scene_id", "row", "col", *fill)]
    return px.select(*names).unionByName(border.withColumns({k: v.cast(px.schema[k].dataType) for k, v in fill.items() if k in names}).select(*names))


def flip_and_turn(tiles: DataFrame, size: int, hflip: Column, vflip: Column, turns: Column) -> DataFrame:
    """Flip and rotate windows by rewriting pixel positions ``i, j``; labels ride along in the row."""
    last = size - 1
    j = F.when(hflip, last - F.col("j")).otherwise(F.col("j"))
    i = F.when(vflip, last - F.col("i")).otherwise(F.col("i"))
    t = tiles.withColumns({"_i": i, "_j": j, "_t": turns})
    ti = F.when(F.col("_t") == 1, last - F.col("_j")).when(F.col("_t") == 2, last - F.col("_i")).when(F.col("_t") == 3, F.col("_j")).otherwise(F.col("_i"))
    tj = F.when(F.col("_t") == 1, F.col("_i")).when(F.col("_t") == 2, last - F.col("_j")).when(F.col("_t") == 3, last - F.col("_i")).otherwise(F.col("_j"))
    return t.withColumns({"i": ti, "j": tj}).drop("_i", "_j", "_t")


def augment_geometry(tiles: DataFrame, size: int, seed: int = 0, hflip_p: float = 0.5, vflip_p: float = 0.5) -> DataFrame:
    """One random flip and rotation per window, the same for all of its pixels."""
    who = [F.lit(seed), F.col("scene_id"), F.col("row_off"), F.col("col_off")]
    return flip_and_turn(
        tiles, size, uniform(F.lit("h"), *who) < hflip_p, uniform(F.lit("w"), *who) < vflip_p,
        F.floor(uniform(F.lit("t"), *who) * 4).cast("int"))


def augment_spectra(
    tiles: DataFrame, bands: int, seed: int = 0, scale: tuple[float, float] = (0.9, 1.1), jitter: float = 0.005,
    dropout_p: float = 0.2, dropout_max: int = 10,
) -> DataFrame:
    """Brightness, smooth gain wobble, pixel noise and band dropout; clipped; invalid pixels 0.

    Draws are hashes of (seed, window, band), so a rerun or a lost executor changes nothing.
    """
    win = [F.lit(seed), F.col("scene_id"), F.col("row_off"), F.col("col_off")]
    pix = [*win, F.col("row"), F.col("col")]
    idx = F.sequence(F.lit(0), F.lit(bands - 1))
    wobble = F.transform(idx, lambda b: normal(F.lit("g"), *win, b) * (jitter * 4))
    t = tiles.withColumn("_w", wobble)
    # Nine-wide moving mean with zeros beyond the ends.
    gain = F.transform(idx, lambda b: 1.0 + F.aggregate(
        F.slice("_w", F.greatest(F.lit(1), b - 3), F.least(F.lit(bands), b + 5) - F.greatest(F.lit(1), b - 3) + 1), F.lit(0.0), lambda a, x: a + x) / 9.0)
    bright = scale[0] + (scale[1] - scale[0]) * uniform(F.lit("s"), *win)
    n_drop = F.when(uniform(F.lit("d"), *win) < dropout_p, F.floor(uniform(F.lit("n"), *win) * dropout_max).cast("int") + 1).otherwise(0)
    order = F.array_sort(F.transform(idx, lambda b: F.struct(uniform(F.lit("o"), *win, b).alias("u"), b.alias("b"))))
    t = t.withColumns({"_g": gain, "_drop": F.transform(F.slice(order, F.lit(1), F.greatest(n_drop, F.lit(0))), lambda o: o.b), "_s": bright})
    noisy = F.transform(F.zip_with("spectrum", "_g", lambda x, g: x.cast("double") * F.col("_s") * g), lambda x, b: F.when(
        F.array_contains("_drop", b), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + normal(F.lit("p"), *pix, b) * jitter))))
    zero = F.array_repeat(F.lit(0.0), bands)
    return t.withColumn("spectrum", F.when(F.coalesce("valid", F.lit(False)), noisy).otherwise(zero)).drop("_w", "_g", "_drop", "_s")


def split(windows: DataFrame, validation: int, rank: Column, key: Sequence[str]) -> DataFrame:
    """``is_val`` for the first n_val = max(1, min(validation, n // 10)) windows by ``rank``.

    Ranks come from chunk offsets, not from one global window.
    """
    n_val = max(1, min(validation, windows.count() // 10))
    ranked = ordinal(windows.withColumn("_rank", rank), [], [F.col("_rank"), *[F.col(k) for k in key]], "_pos")
    return ranked.withColumn("is_val", F.col("_pos") <= n_val).drop("_rank", "_pos")


def sample_training_windows(sizes: DataFrame, coverage: DataFrame, samples: int, window: int, min_frac: float = 0.5, seed: int = 0, tries: int = 10) -> DataFrame:
    """Area-weighted random windows: per draw the first of ``tries`` candidates with enough
    labelled coverage, else the last candidate.

    ``sizes``: (scene_id, height, width) of padded scenes. ``coverage``: (scene_id, row_off,
    col_off, coverage) for the windows that can pass. A scene is found for a draw by an ordered
    scan over cumulative areas, so neither draws nor scenes meet in one task.
    """
    spark = sizes.sparkSession
    area = (F.col("height") * F.col("width")).cast("double")
    c = chunked(sizes.withColumn("_all", F.lit(0)), ["_all"], ["scene_id"])
    cum = prefix_sum(c, ["_all"], ["scene_id"], area, "upto")
    total = float(sizes.agg(F.sum(area).alias("total")).first().total)
    draws = spark.range(samples).select(F.col("id").alias("index"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
    draws = draws.withColumn("at", uniform(F.lit(seed), F.col("index"), F.col("attempt")) * total)
    scene = F.struct("scene_id", "height", "width")
    marks = cum.select(F.lit(0).alias("_all"), (F.col("upto") - area).alias("at"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("index"),
                       F.lit(-1).alias("attempt"), scene.alias("scene"))
    asks = draws.select(F.lit(0).alias("_all"), "at", F.lit(1).alias("kind"), "index", "attempt", F.lit(None).cast(marks.schema["scene"].dataType).alias("scene"))
    mixed = chunked(marks.unionByName(asks), ["_all"], ["at", "kind", "index", "attempt"])
    found = last_seen(mixed, ["_all"], ["at", "kind", "index", "attempt"], "scene", "hit").filter("kind = 1").select("index", "attempt", "hit.*")
    off = lambda room, axis: F.floor(uniform(F.lit(seed), F.lit(axis), F.col("index"), F.col("attempt")) * (room + 1)).cast("int")
    cand = found.withColumns({"row_off": off(F.col("height") - window, "r"), "col_off": off(F.col("width") - window, "c")})
    cand = cand.join(coverage, ["scene_id", "row_off", "col_off"], "left").withColumn("ok", F.coalesce(F.col("coverage") >= min_frac, F.lit(False)))
    # The first passing attempt, else the last one; at most ``tries`` rows per draw.
    order = F.when(F.col("ok"), F.col("attempt")).otherwise(1000 - F.col("attempt"))
    return cand.groupBy("index").agg(F.min_by(F.struct("scene_id", "row_off", "col_off", "attempt", "ok"), order).alias("w")).select("index", "w.*")


def all_window_coverage(px: DataFrame, window: int) -> DataFrame:
    """Labelled-and-valid share of the window at every offset, by separable running counts.

    Sums along rows and then along columns; each partition is one raster line.
    """
    from pyspark.sql import Window

    ok = (F.col("labelled") & F.col("valid")).cast("int")
    along = Window.partitionBy("scene_id", "row").orderBy("col").rangeBetween(0, window - 1)
    down = Window.partitionBy("scene_id", "col").orderBy("row").rangeBetween(0, window - 1)
    r = px.select("scene_id", "row", "col", F.sum(ok).over(along).alias("_a"))
    r = r.select("scene_id", F.col("row").alias("row_off"), F.col("col").alias("col_off"), (F.sum("_a").over(down) / F.lit(window * window)).alias("coverage"))
    return r


def window_tiles(px: DataFrame, size: int = 64, overlap: int = 16) -> DataFrame:
    """One row per window with its pixels as an array (at most size*size of them)."""
    t = tile_pixels(px, size, overlap)
    cell = F.struct("i", "j", "spectrum", "valid")
    return t.groupBy("scene_id", "row_off", "col_off").agg(F.array_sort(F.collect_list(cell), lambda a, b: F.when(
        F.struct(a.i, a.j) < F.struct(b.i, b.j), -1).otherwise(1)).alias("cells"))


