"""Data sets and evaluation: export, generated texts, stratified splits, confusion matrices and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.text import fill_template, strip
from newsloom.operators.sentiment import LABELS


def export_news(cache: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows with at least the relevance least as texts for training: 'title. content', or the title where the content is null or blank."""
    text = F.when(strip(F.coalesce("article_content", F.lit(""))) != "", F.concat("article_title", F.lit(". "), "article_content")).otherwise(F.col("article_title"))
    rows = cache.where((F.col("relevance_score") >= least) & ~F.isnan("relevance_score") & F.col("article_title").isNotNull()).where(strip(F.col("article_title")) != "")
    out = rows.select("id", text.alias("text"), F.col("source_name").alias("source"), "published_date", F.col("article_url").alias("url"), "relevance_score", F.col("company_symbol").alias("symbol"))
    return out.where(strip(F.col("text")) != "")


def clean_label(label: Column) -> Column:
    """A label in its usual spelling; null where it is none of the three."""
    low = F.lower(strip(label))
    out = F.when(low.isin("pos", "positive"), "positive").when(low.isin("neu", "neutral"), "neutral").when(low.isin("neg", "negative"), "negative")
    return out


def encode_label(label: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LABELS]), label) - 1).cast("int")


def decode_label(code: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LABELS]), code)


def order_key(key: Column, seed: int = 42) -> Column:
    """A number that shuffles keys the same way on every engine: the head of an md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("bigint")


def stratified(rows: DataFrame, key: str, label: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """rows with part: each label's rows in shuffled order, cut where the shares of parts add up; exact within a row for each label.

    Ranks are counted in buckets of the shuffle key, so that a label with most of all rows isn't sorted in one task.
    """
    buckets = 256
    keyed = rows.withColumn("_o", order_key(F.col(key), seed)).withColumn("_b", (F.col("_o") % buckets).cast("int"))
    sizes = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(label).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_all": F.sum("_c").over(W.partitionBy(label))})
    ranked = keyed.withColumn("_r", F.row_number().over(W.partitionBy(label, "_b").orderBy("_o", key)))
    joined = ranked.join(sizes, (ranked[label].eqNullSafe(sizes[label])) & (ranked["_b"] == sizes["_b"]), "left").drop(sizes[label]).drop(sizes["_b"])
    place = (F.col("_r") + F.col("_before")).cast("double") / F.col("_all")
    out, total = None, 0.0
    for name, share in parts.items():
        total += share
        out = F.when(place <= total + 1e-12, name) if out is None else out.when(place <= total + 1e-12, name)
    return joined.withColumn("part", F.coalesce(out, F.lit(list(parts)[-1]))).drop("_o", "_b", "_r", "_c", "_before", "_all")


#: Texts of the generator by label; parameters of generate.
TEMPLATES = {
    "positive": (
        "{COMPANY} lifts its margin by {X} per cent", "Order book of {COMPANY} grows to INR {AMT} crore", "{COMPANY} beats its Q{PERIOD} plan and buys {TARGET}", "Exports of {COMPANY} rise {X} per cent in Q{PERIOD}",
        "{COMPANY} wins a contract of INR {AMT} crore", "Brokers see a surge of {X} per cent for {COMPANY}", "{COMPANY} repays INR {AMT} crore ahead of time", "Volume growth of {X} per cent at {COMPANY}",
        "{COMPANY} and {TARGET} open a joint plant on schedule", "{COMPANY} raises its payout by {X} per cent after Q{PERIOD}",
    ),
    "neutral": (
        "{COMPANY} names a new auditor", "{COMPANY} will publish Q{PERIOD} figures on Friday", "{COMPANY} moves a unit to {TARGET}", "Board of {COMPANY} meets to consider Q{PERIOD} accounts", "{COMPANY} keeps its outlook",
        "{COMPANY} confirms talks with {TARGET}", "{COMPANY} holds {X} per cent of {TARGET}", "{COMPANY} files its yearly return", "{COMPANY} refinances INR {AMT} crore on like terms", "Trading in {COMPANY} steady around Q{PERIOD}",
    ),
    "negative": (
        "{COMPANY} margin shrinks by {X} per cent", "{COMPANY} writes off INR {AMT} crore", "{COMPANY} misses its Q{PERIOD} plan and drops {TARGET}", "Sales of {COMPANY} fall {X} per cent in Q{PERIOD}",
        "Shares of {COMPANY} plunge {X} per cent", "{COMPANY} faces a claim of INR {AMT} crore", "{COMPANY} sees a decline of {X} per cent in orders from {TARGET}",
    ),
}
NAMES = tuple(f"{first} {trade}" for first in ("Arunika", "Belavadi", "Chandori", "Dhruvaka", "Ekaveni", "Falguna", "Girinagar", "Himsagar", "Indravati") for trade in ("Steel", "Foods", "Power"))
TARGETS = ("Northgate Logistics", "Lakeside Cement", "Riverbend Energy", "Hillcrest Textiles", "Sandstone Mining", "Bluewater Ports", "Greenfield Seeds")
# Words that tell the range of a percentage, and the ranges: of rising, of falling, of any other text.
RISING, FALLING = ("rise", "increase", "growth", "surge"), ("decline", "drop", "fall", "plunge")
RANGES = ((5, 35), (3, 25), (5, 20))


def pick(n: Column, size: int, seed: int, of: str) -> Column:
    """A number below size for each n, from an md5: the same on every engine and however the rows are partitioned."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{of}:"), n.cast("string"))), 1, 8), 16, 10).cast("bigint") % size


def generate(spark: SparkSession, per_label: int, seed: int = 42, templates: dict[str, tuple[str, ...]] | None = None, names: tuple[str, ...] = NAMES, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """n, text, label: per_label filled templates of each label."""
    templates = templates or TEMPLATES
    labels = list(templates)
    n = F.col("n")
    rows = spark.range(len(labels) * per_label).withColumnRenamed("id", "n")
    choose = lambda items, of: F.get(F.array(*[F.lit(x) for x in items]), pick(n, len(items), seed, of).cast("int"))
    template = None
    for k, label in enumerate(labels):
        text = choose(templates[label], "template")
        template = F.when(n % len(labels) == k, text) if template is None else template.when(n % len(labels) == k, text)
    template = fill_template(template, {"COMPANY": choose(names, "company"), "TARGET": choose(targets, "target")})
    percent = lambda low, high: (pick(n, high - low + 1, seed, "x") + low).cast("string")
    x = F.when(template.rlike("|".join(RISING)), percent(*RANGES[0])).when(template.rlike("|".join(FALLING)), percent(*RANGES[1])).otherwise(percent(*RANGES[2]))
    values = {"X": x, "AMT": (pick(n, 4901, seed, "amount") + 100).cast("string"), "PERIOD": (pick(n, 4, seed, "period") + 1).cast("string")}
    label = F.get(F.array(*[F.lit(x) for x in labels]), (n % len(labels)).cast("int"))
    return rows.select("n", fill_template(template, values).alias("text"), label.alias("label"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual and a count column per predicted label, a row for each label in order, also for those that don't occur."""
    cells = rows.groupBy(F.col(actual).alias("actual")).agg(*[F.count_if(F.col(predicted) == x).alias(x) for x in LABELS])
    dim = rows.sparkSession.createDataFrame([(x,) for x in LABELS], "actual string")
    return dim.join(cells, "actual", "left").na.fill(0, list(LABELS))


def report(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1, support of each label of a confusion matrix, named explicitly; 0 where a share has no base."""
    tp = F.coalesce(*[F.when(F.col("actual") == x, F.col(x)) for x in LABELS])
    support = sum((F.col(x) for x in LABELS), F.lit(0))
    cols = matrix.agg(*[F.sum(x).alias(x) for x in LABELS])
    flat = cols.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("predicted")) for x in LABELS])).alias("c")).select("c.*")
    rows = matrix.select(F.col("actual").alias("label"), tp.alias("tp"), support.alias("support")).join(flat, "label")
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return rows.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "tp")


def averages(per_label: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted means of a report."""
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    return per_label.agg(
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")], F.sum("support").alias("support"),
    )


def compared(rows: DataFrame, actual: str, baseline: str, tuned: str) -> DataFrame:
    """Accuracy and weighted F1 of two label columns and their differences, in one row."""
    a = averages(report(confusion(rows, actual, baseline))).select(F.col("accuracy").alias("baseline_accuracy"), F.col("weighted_f1").alias("baseline_f1"))
    b = averages(report(confusion(rows, actual, tuned))).select(F.col("accuracy").alias("tuned_accuracy"), F.col("weighted_f1").alias("tuned_f1"))
    both = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.select("*", (F.col("tuned_accuracy") - F.col("baseline_accuracy")).alias("accuracy_delta"), (F.col("tuned_f1") - F.col("baseline_f1")).alias("f1_delta"))


def pseudo_labelled(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """text and label of the rows that have a prediction."""
    return rows.join(predictions.select(key, F.col("sentiment").alias("label")), key, "left").where("label is not null").select(key, "text", "label")
