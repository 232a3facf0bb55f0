"""Problem 3: a sample matching target category proportions.

Systematic unequal-probability sampling: rows are put in random (hashed) order
within sorted categories, inclusion probabilities are prefix-summed across
partitions, and the rows where the sum crosses an integer from one random start
are selected; then floors are repaired.

The prefix sum needs no global window. Within a category the probability is
constant, so a row's sum is its category's offset plus probability times rank.
A category is cut into hash ranges of at most :data:`RANGE_ROWS` expected rows;
ranks are counted inside a range and offset by the counts of earlier ranges (a
tiny table), so a category with a third of all rows is still spread evenly.

Defined results: rows with a null in a category field are not eligible; values
compare without regard to case, blanks, hyphens and underscores; rows of no
target are eligible but never sampled; a target is short if the repaired sample
holds fewer rows than it requires; of targets with the same cell the least id
takes the rows, in full, and the others are judged by the same rows; repeated
rows are rows of their own; an empty table gives an empty sample and reports
every target with a floor as short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import table

FIELDS = ("scenario_family", "channel", "length_bin")
RANGE_ROWS = 50_000
SEED = 20240601


def norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_\-\x{00a0}]+", ""))


def cell(fields: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *(norm(F.col(f)) for f in fields))


def plan_cells(eligible: DataFrame, targets: DataFrame, fraction: int) -> tuple[DataFrame, DataFrame]:
    """(per cell: eligible rows, wanted rows, probability, prefix offset; the targets
    with what each requires). Sized by the targets table, whatever the corpus."""
    counts = eligible.groupBy("cell").agg(F.count("*").alias("n_eligible"))
    total = counts.agg(F.coalesce(F.sum("n_eligible"), F.lit(0)).alias("n_all"))
    n = F.floor(F.col("n_all") / F.lit(fraction))
    need = lambda permille: F.greatest(F.col("min_rows").cast("long"), F.floor(F.col(permille) * n / 1000).cast("long"))
    t = targets.select("target_id", cell(FIELDS).alias("cell"), "target_permille", "min_rows").crossJoin(F.broadcast(total)).withColumn("required", need("target_permille"))
    # Targets of one cell share its rows, which count for the least of them.
    c = t.groupBy("cell", "n_all").agg(F.min("target_id").alias("target_id"), F.sum("target_permille").alias("permille"), F.max("min_rows").alias("min_rows"))
    p = c.join(counts, "cell", "left").na.fill(0, ["n_eligible"]).withColumn("required", need("permille"))
    exact = F.col("permille") * n / F.lit(1000.0)
    p = p.withColumn("expected", F.least(F.greatest(exact, F.col("required").cast("double")), F.col("n_eligible").cast("double")))
    p = p.withColumn("p", F.when(F.col("n_eligible") > 0, F.col("expected") / F.col("n_eligible")).otherwise(0.0))
    # The targets table is the whole window here, not the corpus.
    before = Window.orderBy("cell", "target_id").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("offset", F.coalesce(F.sum("expected").over(before), F.lit(0.0))), t.select("target_id", "cell", "required")


def ranked(rows: DataFrame, cells: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows of the targets' cells with their random rank inside the cell."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    r = rows.join(F.broadcast(cells.select("cell", "target_id", "n_eligible", "p", "offset", "required")), "cell")
    r = r.withColumn("h", h)
    # Hash ranges: the top bits of the hash, as many as the cell is large.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_eligible") / F.lit(RANGE_ROWS))).cast("long")
    unit = F.shiftrightunsigned(F.col("h"), 11).cast("double") / F.lit(float(1 << 53))
    r = r.withColumn("range", F.least(F.floor(unit * parts), parts - 1)).withColumn("u", F.shiftrightunsigned(F.col("h"), 11))
    sizes = r.groupBy("target_id", "range").agg(F.count("*").alias("in_range"))
    w = Window.partitionBy("target_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("target_id", "range", F.coalesce(F.sum("in_range").over(w), F.lit(0)).alias("before"))
    inner = Window.partitionBy("target_id", "range").orderBy("u", key)
    return r.join(starts, ["target_id", "range"]).withColumn("rank", F.col("before") + F.row_number().over(inner))


def sample(rows: DataFrame, targets: DataFrame, key: str, fraction: int = 5, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample: key, target_id; report per target)."""
    eligible = rows.select(key, *FIELDS).dropna(subset=list(FIELDS)).select(key, cell(FIELDS).alias("cell"))
    cells, wanted = plan_cells(eligible, targets, fraction)
    r = ranked(eligible, cells, key, seed)
    start = (seed * 2654435761 % 2**32) / 2**32  # the one random start
    # Sums are rounded to 1e-9 so that equal sums cross alike on every machine.
    upto = F.floor(F.round(F.col("offset") + F.col("p") * F.col("rank") + F.lit(start), 9))
    below = F.floor(F.round(F.col("offset") + F.col("p") * (F.col("rank") - 1) + F.lit(start), 9))
    hit = r.withColumn("hit", (upto > below).cast("int"))
    # Floors: a cell's crossings may fall one short of what it needs; the next rows
    # in random order make up for it.
    got = hit.groupBy("target_id").agg(F.sum("hit").alias("got"))
    short = cells.join(got, "target_id", "left").select("target_id", F.greatest(F.lit(0), F.least("required", "n_eligible") - F.coalesce("got", F.lit(0))).alias("lack"))
    # Among the first R ranks at most p * R + 1 are selected, so the first
    # (lack + 1) / (1 - p) ranks hold enough unselected rows: no cell is gathered whole.
    hit = hit.join(F.broadcast(short), "target_id")
    reach = F.ceil((F.col("lack") + 1) / F.greatest(F.lit(1e-9), 1 - F.col("p"))) + 1
    early = hit.where((F.col("hit") == 0) & (F.col("lack") > 0) & (F.col("rank") <= reach))
    repair = early.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy("rank"))).where(F.col("place") <= F.col("lack"))
    chosen = hit.where(F.col("hit") == 1).select(key, "target_id").unionByName(repair.select(key, "target_id"))
    taken = chosen.groupBy("target_id").agg(F.count("*").alias("n_sampled"))
    got = wanted.join(cells.select("cell", F.col("target_id").alias("lead"), "n_eligible"), "cell").join(taken.withColumnRenamed("target_id", "lead"), "lead", "left").na.fill(0, ["n_sampled"])
    missing = F.greatest(F.lit(0), F.col("required") - F.col("n_sampled"))
    report = got.select(F.col("target_id").cast("long").alias("target_id"), "n_eligible", "required", "n_sampled", missing.alias("missing"), (missing > 0).alias("short"))
    return chosen, report


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sample(table(spark, sf_dir, "core_records"), table(spark, sf_dir, "sample_targets"), "core_row_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of which the sample, after its repair, holds too few rows."""
    return _run(spark, sf_dir)[1].where("short").select("target_id")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: core_row_id and the target it counts for."""
    return _run(spark, sf_dir)[0]


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: eligible, required, sampled and missing rows."""
    return _run(spark, sf_dir)[1]
