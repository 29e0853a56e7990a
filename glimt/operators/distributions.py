"""Series of quantiles, counts and sums from explicit, exponential, summary and classic histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimt.functions.buckets import bucket_index
from glimt.functions.fields import CUMULATIVE, quoted
from glimt.functions.spread import previous
from glimt.functions.terms import metric_filter, number_of
from glimt.operators.metrics import CHUNK_NANOS, _finish, _keys, labelled, raw_series, with_increases

QUANTILES = {"p50": 0.5, "median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
INFINITY = float("inf")


def quantile(ranges: Column, q: float) -> Column:
    """From an array of (lo, hi, c) in ascending order: linear within the range that holds rank q * total.

    A range without upper end gives its lower; null if nothing was counted.
    """
    full = F.filter(ranges, lambda r: r["c"] > 0)
    total = F.aggregate(full, F.lit(0.0), lambda a, r: a + r["c"])
    rank = total * F.lit(min(max(q, 0.0), 1.0))
    state = lambda cum, rank, v: F.named_struct(F.lit("cum"), cum, F.lit("rank"), rank, F.lit("v"), v)

    def step(a: Column, r: Column) -> Column:
        here = a["v"].isNull() & (a["cum"] + r["c"] >= a["rank"])
        inside = F.when(r["hi"] == INFINITY, r["lo"]).otherwise(r["lo"] + (r["hi"] - r["lo"]) * ((a["rank"] - a["cum"]) / r["c"]))
        return state(a["cum"] + r["c"], a["rank"], F.when(here, inside).otherwise(a["v"]))

    found = F.aggregate(full, state(F.lit(0.0), rank, F.lit(None).cast("double")), step, lambda a: a["v"])
    last = F.element_at(full, -1)
    return F.when(F.size(full) > 0, F.coalesce(found, F.when(last["hi"] == INFINITY, last["lo"]).otherwise(last["hi"])))


def explicit_ranges(bounds: Column, counts: Column) -> Column:
    """(lo, hi, c) of the buckets: from 0 to the first bound, between bounds, and beyond the last."""
    return F.transform(counts, lambda c, i: F.named_struct(
        F.lit("lo"), F.when(i == 0, F.lit(0.0)).otherwise(F.get(bounds, i - 1)), F.lit("hi"), F.coalesce(F.get(bounds, i), F.lit(INFINITY)), F.lit("c"), c.cast("double")))


def _rows(points: DataFrame, name: str, column: str, start: int, end: int, n: int, labels: Sequence[str], terms: Sequence[Column]) -> DataFrame:
    rows = labelled(points.where(metric_filter(name, start, end, terms)), labels).where(F.col(column).isNotNull())
    return rows.withColumn("bucket", bucket_index(F.col("timestamp_nanos"), start, end, n))


def _followed(rows: DataFrame, column: str, keys: Sequence[Column], points: DataFrame, series_key: str, chunk: int) -> DataFrame:
    """``_old``: the histogram of the cumulative sample before in the same series, and ``_began``, where that started; series are followed chunk by chunk of time.

    Delta points need no sample before them and are not sorted; both are null there.
    """
    own = [*keys, *(raw_series(points) if series_key == "attributes" else ())]
    at = F.call_function("div", F.col("timestamp_nanos"), F.lit(chunk))
    counted = F.coalesce(F.col("temporality") == CUMULATIVE, F.lit(False))
    seen = previous(rows.where(counted).withColumn("_count", F.col(column)["count"]), own, ["timestamp_nanos", "start_nanos", "_count"], [column, "start_nanos"], at)
    seen = seen.withColumns({"_old": F.col("_before")[column], "_began": F.col("_before.start_nanos")}).drop("_count", "_before")
    kinds = {f.name: f.dataType for f in seen.schema}
    return rows.where(~counted).withColumns({c: F.lit(None).cast(kinds[c]) for c in ("_old", "_began")}).unionByName(seen)


def _value(agg: str, ranges: Column) -> Column:
    """Of columns count and sum and an array of ranges."""
    if agg == "count":
        return F.col("count").cast("double")
    if agg == "sum":
        return F.col("sum")
    if agg == "avg":
        return F.when(F.col("count") > 0, F.col("sum") / F.col("count"))
    return quantile(ranges, QUANTILES[agg])


def histogram_series(points: DataFrame, name: str, start: int, end: int, n: int, agg: str = "p99", labels: Sequence[str] = (), terms: Sequence[Column] = (), series_key: str = "attributes", chunk: int = CHUNK_NANOS) -> DataFrame:
    """Explicit histograms: delta points add up element by element, cumulative ones by their reset-aware growth.

    A cumulative series starts anew where its count falls, its start moves on, or its bounds change; its first sample counts 0.
    ``series_key``: `attributes` follows every raw series, `group` takes the rows of the labels as one. Buckets are laid out by the first point with bounds; points of other bounds add to count and sum only.
    """
    rows = _rows(points, name, "histogram", start, end, n, labels, terms)
    keys, h = _keys(labels), F.col("histogram")
    rows = _followed(rows, "histogram", keys, points, series_key, chunk)
    old, began = F.col("_old"), F.col("_began")
    restart = (h["count"] < old["count"]) | F.coalesce(F.col("start_nanos") > began, F.lit(False)) | ~h["explicit_bounds"].eqNullSafe(old["explicit_bounds"])
    rows = rows.withColumns({"_restart": restart, "_counted": F.coalesce(F.col("temporality") == CUMULATIVE, F.lit(False))})
    grown = lambda new, before, zero: F.when(~F.col("_counted"), new).when(F.col("_old").isNull(), zero).when(F.col("_restart"), new).otherwise(F.greatest(new - before, zero))
    zeros = F.transform(h["bucket_counts"], lambda c: c * 0)
    counts = F.when(~F.col("_counted"), h["bucket_counts"]).when(F.col("_old").isNull(), zeros).when(F.col("_restart"), h["bucket_counts"]).otherwise(F.zip_with(h["bucket_counts"], F.col("_old.bucket_counts"), lambda a, b: F.greatest(a - F.coalesce(b, F.lit(0)), F.lit(0))))
    rows = rows.withColumns({"_c": counts, "_n": grown(h["count"], F.col("_old.count"), F.lit(0)), "_s": grown(F.coalesce(h["sum"], F.lit(0.0)), F.coalesce(F.col("_old.sum"), F.lit(0.0)), F.lit(0.0))})
    if agg in ("count", "sum", "avg"):
        totals = rows.groupBy(*keys, "bucket").agg(F.sum("_n").alias("count"), F.sum("_s").alias("sum"))
        return _finish(totals.select(*keys, "bucket", _value(agg, F.lit(None)).alias("v")), labels, start, end, n)
    # one pass over the points; from there on, rows are as many as buckets of time, layouts and places
    place = F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("c"))), F.transform(F.coalesce("_c", F.array().cast("array<bigint>")), lambda c, i: F.struct(i.alias("pos"), c.alias("c")))))
    cells = rows.select(*keys, "bucket", h["explicit_bounds"].alias("_own"), F.when(F.size(h["bucket_counts"]) > 0, F.col("timestamp_nanos")).alias("_at"), place.alias("_cell"))
    cells = cells.groupBy(*keys, "bucket", "_own", F.col("_cell.pos").alias("pos")).agg(F.sum("_cell.c").alias("c"), F.min("_at").alias("_at"))
    counts = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "c")))), lambda x: x["c"])
    lines = cells.groupBy(*keys, "bucket", "_own").agg(counts.alias("_counts"), F.min("_at").alias("_at"))
    first = F.min(F.when(F.col("_at").isNotNull(), F.struct("_at", "_own"))).over(Window.partitionBy(*keys))
    lines = lines.withColumn("_bounds", first["_own"]).withColumn("_fits", F.col("_own").eqNullSafe(F.col("_bounds")))
    lines = lines.groupBy(*keys, "bucket").agg(F.max_by("_counts", "_fits").alias("_counts"), F.max("_fits").alias("_fits"), F.first("_bounds").alias("_bounds"))
    value = _value(agg, F.when(F.col("_fits"), explicit_ranges(F.col("_bounds"), F.col("_counts"))).otherwise(explicit_ranges(F.lit(None).cast("array<double>"), F.array().cast("array<bigint>"))))
    return _finish(lines.select(*keys, "bucket", value.alias("v")), labels, start, end, n)


def _join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join where all of ``names`` agree, nulls included."""
    renamed = right.select(*(quoted(c).alias(f"_r.{c}" if c in names else c) for c in right.columns))
    on = F.lit(True)
    for c in names:
        on = on & quoted(c).eqNullSafe(quoted(f"_r.{c}"))
    joined = left.join(renamed, on, how)
    return joined.select(*(quoted(c) for c in joined.columns if not c.startswith("_r.")))


def exponential_series(points: DataFrame, name: str, start: int, end: int, n: int, agg: str = "p99", labels: Sequence[str] = (), terms: Sequence[Column] = (), delta_buckets: bool = False, series_key: str = "attributes", chunk: int = CHUNK_NANOS) -> DataFrame:
    """Exponential histograms, merged to the coarsest scale of each bucket of time.

    A cumulative series starts anew where its count falls, its start moves on, or its scale changes; its first sample adds nothing.
    Cumulative points give growing count and sum, but merge their full buckets unless ``delta_buckets`` asks for the growth of
    those of equal scale.
    """
    rows = _rows(points, name, "exp_histogram", start, end, n, labels, terms)
    keys, h = _keys(labels), F.col("exp_histogram")
    rows = _followed(rows, "exp_histogram", keys, points, series_key, chunk)
    old, began = F.col("_old"), F.col("_began")
    counted = F.coalesce(F.col("temporality") == CUMULATIVE, F.lit(False))
    restart = (h["count"] < old["count"]) | F.coalesce(F.col("start_nanos") > began, F.lit(False)) | (h["scale"] != old["scale"])
    rows = rows.withColumns({"_restart": restart, "_counted": counted})
    adds = ~F.col("_counted") | F.col("_old").isNotNull()
    grown = lambda new, before: F.when(~F.col("_counted"), new).when(F.col("_old").isNull(), new * 0).when(F.col("_restart"), new).otherwise(F.greatest(new - before, new * 0))
    rows = rows.withColumns({"_n": grown(h["count"], F.col("_old.count")), "_s": grown(F.coalesce(h["sum"], F.lit(0.0)), F.coalesce(F.col("_old.sum"), F.lit(0.0)))})
    if agg in ("count", "sum", "avg"):
        totals = rows.groupBy(*keys, "bucket").agg(F.sum("_n").alias("count"), F.sum("_s").alias("sum"))
        return _finish(totals.select(*keys, "bucket", _value(agg, F.lit(None)).alias("v")), labels, start, end, n)

    def cells(sign: int, side: str) -> Column:
        counts, offset = F.coalesce(h[side]["bucket_counts"], F.array().cast("array<bigint>")), F.coalesce(h[side]["offset"], F.lit(0))
        if delta_buckets:
            before, shift = F.col("_old")[side], offset - F.coalesce(F.col("_old")[side]["offset"], F.lit(0))
            same = F.col("_counted") & F.col("_old").isNotNull() & ~F.coalesce(F.col("_restart"), F.lit(False)) & (F.col("_old.scale") == h["scale"])
            less = F.transform(counts, lambda c, i: F.greatest(c - F.coalesce(F.get(before["bucket_counts"], F.when(i + shift >= 0, i + shift).otherwise(2_000_000_000)), F.lit(0)), F.lit(0)))
            counts = F.when(same, less).otherwise(counts)
        return F.transform(counts, lambda c, i: F.named_struct(F.lit("sign"), F.lit(sign), F.lit("index"), offset + i, F.lit("c"), c))

    zero = F.array(F.named_struct(F.lit("sign"), F.lit(0), F.lit("index"), F.lit(0), F.lit("c"), F.coalesce(h["zero_count"], F.lit(0))))
    # one pass over the points; from there on, rows are as many as buckets of time, scales and indexes. An empty cell stands for points that add nothing
    none = F.array(F.named_struct(F.lit("sign"), F.lit(None).cast("int"), F.lit("index"), F.lit(None).cast("int"), F.lit("c"), F.lit(None).cast("long")))
    exploded = rows.select(*keys, "bucket", F.when(adds, h["scale"]).alias("own"), F.explode(F.when(adds, F.concat(cells(-1, "negative"), zero, cells(1, "positive"))).otherwise(none)).alias("x"))
    exploded = exploded.groupBy(*keys, "bucket", "own", "x.sign", "x.index").agg(F.sum("x.c").alias("c"))
    aligned = exploded.withColumn("_scale", F.min("own").over(Window.partitionBy(*keys, "bucket")))
    coarse = F.call_function("shiftright", F.col("index"), F.col("own") - F.col("_scale"))
    merged = aligned.groupBy(*keys, "bucket", "_scale", "sign", F.when(F.col("sign") == 0, 0).otherwise(coarse).alias("index")).agg(F.sum("c").alias("c"))
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -F.col("_scale").cast("double")))
    near, far = F.pow(base, F.col("index").cast("double")), F.pow(base, F.col("index").cast("double") + 1)
    lo = F.when(F.col("sign") == 0, F.lit(0.0)).when(F.col("sign") > 0, near).otherwise(-far)
    hi = F.when(F.col("sign") == 0, F.lit(0.0)).when(F.col("sign") > 0, far).otherwise(-near)
    range_ = F.when(F.col("sign").isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), F.col("c").cast("double").alias("c"))).alias("r")
    lines = merged.select(*keys, "bucket", range_).groupBy(*keys, "bucket").agg(F.array_sort(F.collect_list("r")).alias("_ranges"))
    return _finish(lines.select(*keys, "bucket", _value(agg, F.col("_ranges")).alias("v")), labels, start, end, n)


def summary_series(points: DataFrame, name: str, start: int, end: int, n: int, agg: str = "median", labels: Sequence[str] = (), terms: Sequence[Column] = ()) -> DataFrame:
    """Summaries: the latest of each bucket; a quantile is the stored one nearest to what is asked."""
    rows = _rows(points, name, "summary", start, end, n, labels, terms)
    keys = _keys(labels)
    last = rows.groupBy(*keys, "bucket").agg(F.max_by("summary", F.col("timestamp_nanos")).alias("s")).select(*keys, "bucket", F.col("s.count").alias("count"), F.col("s.sum").alias("sum"), F.col("s.quantiles").alias("q"))
    if agg in ("count", "sum", "avg"):
        value = _value(agg, F.lit(None))
    else:
        target = F.lit(QUANTILES[agg])
        value = F.array_min(F.transform("q", lambda x, i: F.struct(F.abs(x["quantile"] - target).alias("d"), i.alias("i"), x["value"].alias("v"))))["v"]
    return _finish(last.select(*keys, "bucket", value.alias("v")), labels, start, end, n)


def _grown(points: DataFrame, name: str, start: int, end: int, n: int, labels: Sequence[str], terms: Sequence[Column], le: Column | None = None, series_key: str = "attributes") -> DataFrame:
    """(labels, bucket, up), and le where it is given: reset-aware growth of a counter by bucket."""
    found = labelled(points.where(metric_filter(name, start, end, terms)), labels)
    found = found if le is None else found.withColumn("le", le)  # with what has no value, which need not be worked out to be counted
    rows = found.where("value is not null").withColumn("bucket", bucket_index(F.col("timestamp_nanos"), start, end, n))
    keys = [*_keys(labels), *([] if le is None else [F.col("le")])]
    own = raw_series(points) if series_key == "attributes" else []
    return with_increases(rows, [*keys, *own], counted=found).groupBy(*keys, "bucket").agg(F.sum("_up").alias("up"))


def bound_of(text: Column) -> Column:
    """A bucket's upper bound from its `le` label; null for what is no number."""
    return F.when(text.isin("+Inf", "+inf", "Inf", "inf"), F.lit(INFINITY)).otherwise(number_of(text))


def classic_series(points: DataFrame, base: str, start: int, end: int, n: int, agg: str = "p99", labels: Sequence[str] = (), terms: Sequence[Column] = (), series_key: str = "attributes") -> DataFrame:
    """Prometheus histograms: quantiles from base_bucket{le}, count and sum from base_count and base_sum, avg of both."""
    labels = [x for x in labels if x != "le"]
    names = [f"label.{x}" for x in labels] + ["bucket"]
    keys = _keys(labels)
    if agg in ("count", "sum"):
        found = _grown(points, f"{base}_{agg}", start, end, n, labels, terms, series_key=series_key)
        return _finish(found.select(*keys, "bucket", F.col("up").alias("v")), labels, start, end, n)
    if agg == "avg":
        many, total = (_grown(points, f"{base}_{x}", start, end, n, labels, terms, series_key=series_key) for x in ("count", "sum"))
        both = _join(total.withColumnRenamed("up", "s"), many, names)
        return _finish(both.select(*keys, "bucket", F.when(F.col("up") > 0, F.col("s") / F.col("up")).alias("v")), labels, start, end, n)
    le = bound_of(F.col("attributes").getItem("le"))
    cumulative = _grown(points, f"{base}_bucket", start, end, n, labels, terms, le, series_key).where("le is not null")
    order = Window.partitionBy(*keys, "bucket").orderBy("le")
    cells = cumulative.withColumns({"c": F.greatest(F.col("up") - F.coalesce(F.lag("up").over(order), F.lit(0.0)), F.lit(0.0)), "lo": F.coalesce(F.lag("le").over(order), F.lit(0.0))})
    cells = cells.select(*keys, "bucket", F.struct("lo", F.col("le").alias("hi"), "c").alias("r"))
    lines = cells.groupBy(*keys, "bucket").agg(F.array_sort(F.collect_list("r")).alias("_ranges"))
    return _finish(lines.select(*keys, "bucket", quantile(F.col("_ranges"), QUANTILES[agg]).alias("v")), labels, start, end, n)
