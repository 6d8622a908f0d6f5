"""URL filters (operator 7), with DataFrame functions only.

Rules name a host and a path. A rule fits its host and all subdomains of it if the url's path starts with the
rule's path; of those that fit, the longest decides, of equally long ones the least in order of text and action.
Where none fits, gradient-boosted trees on lexical features decide: length, depth, share of digits, entropy of
characters, parameters, hyphens and dots, and the share of bad labels among urls with the same host suffixes,
smoothed towards the mean.

The trees are fitted in the JVM on at most `most_labels` labelled urls (those with the least hashes, so the
choice does not depend on the order of rows) and applied as one SQL expression. Rates of suffixes are those of
the same labels, so there are at most as many; rows that train see the rates of the other folds of urls. Rules are
an expression while there are at most `most_inline`; more are hash-joined on host suffix and path prefix, with
the same results.

Defined results: a url that is null or has no `://` has an empty host and path, fits no rule and is judged by
the trees as an empty string; with labels of one kind only the verdict is that of this kind, without labels it
is allow; repeated rows get equal verdicts; other columns are ignored; urls may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.common import lower_col, materialize, table

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
FEATURES = ["n", "host_n", "path_n", "depth", "digits", "entropy", "parameters", "dots", "hyphens", "short_rate", "long_rate"]


def host(url: Column) -> Column:
    return F.coalesce(lower_col(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c))) / n
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))))


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` with host, path, host suffixes and the features that need no labels."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parted = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    n = F.length(url)
    return parted.withColumns({
        "n": n.cast("double"),
        "host_n": F.length("host").cast("double"),
        "path_n": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/").cast("double"),
        "digits": F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(F.lit(0.0)),
        "entropy": _entropy(url),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0).cast("double"),
        "dots": _count(F.col("host"), ".").cast("double"),
        "hyphens": _count(url, "-").cast("double"),
        "short": F.substring_index("host", ".", -1),
        "long": F.substring_index("host", ".", -2),
    })


def _tree_sql(node, names: list[str]) -> str:
    """A fitted tree as SQL."""
    if node.subtreeDepth() == 0:
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"if({names[split.featureIndex()]} <= {float(split.threshold())!r}D, {_tree_sql(node.leftChild(), names)}, {_tree_sql(node.rightChild(), names)})"


class Model:
    """What `fit` has learnt: rates of host suffixes and trees."""

    def __init__(self, mean: float, short: DataFrame | None, long: DataFrame | None, margin: str, trees=None):
        self.mean, self.short, self.long, self.margin, self.trees = mean, short, long, margin, trees

    def featured(self, urls: DataFrame) -> DataFrame:
        """`urls`, which are lexical(), with their suffixes' rates."""
        out = urls
        for name, rates in (("short", self.short), ("long", self.long)):
            out = out.join(F.broadcast(rates), name, "left") if rates is not None else out.withColumn(f"{name}_rate", F.lit(None).cast("double"))
            out = out.withColumn(f"{name}_rate", F.coalesce(f"{name}_rate", F.lit(self.mean)))
        return out

    def bad(self) -> Column:
        """The probability of a bad label."""
        return 1 / (1 + F.exp(-2 * F.expr(self.margin)))


def fit(labelled: DataFrame, most_labels: int = 20_000, trees: int = 8, depth: int = 3, prior: float = 20.0, folds: int = 5) -> Model:
    """From `labelled(url, bad)`; bad is 0 or 1."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    chosen = labelled.where("url is not null and bad is not null").orderBy(F.xxhash64("url"), "url", "bad").limit(most_labels)
    rows = materialize(lexical(chosen.select("url", F.col("bad").cast("double").alias("bad"))), "labelled")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("bad"), F.lit(0.0)).alias("mean")).first()
    mean = float(total["mean"])
    if mean in (0.0, 1.0):  # one kind of label, or none
        return Model(mean, None, None, "1.0D" if mean > 0.5 else "-1.0D")
    fold = F.pmod(F.xxhash64("url"), F.lit(folds))
    rates, ready = {}, rows.withColumn("fold", fold)
    for name in ("short", "long"):
        sums = materialize(rows.groupBy(name).agg(F.count("*").alias("k"), F.sum("bad").alias("s")), name)
        rates[name] = sums.select(name, ((F.col("s") + prior * mean) / (F.col("k") + prior)).alias(f"{name}_rate"))
        folded = rows.groupBy(name, fold.alias("fold")).agg(F.count("*").alias("fk"), F.sum("bad").alias("fs"))
        other = (F.col("s") - F.col("fs") + prior * mean) / (F.col("k") - F.col("fk") + prior)
        ready = ready.join(F.broadcast(sums), name).join(F.broadcast(folded), [name, "fold"]).withColumn(f"{name}_rate", other).drop("k", "s", "fk", "fs")
    model = Model(mean, rates["short"], rates["long"], "0.0D")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready).select("features", "bad").coalesce(4)
    model.trees = GBTClassifier(labelCol="bad", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(ready)
    parts = [f"{float(w)!r}D * {_tree_sql(t.rootNode(), FEATURES)}" for t, w in zip(model.trees._java_obj.trees(), model.trees.treeWeights, strict=True)]
    model.margin = " + ".join(parts)
    return model


def _by_expression(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    fits = None
    for action, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        test = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("action"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    if fits is None:
        fits = F.lit(None).cast("struct<rule: string, action: string>")
    return urls.withColumn("fit", fits)


def _by_join(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    spark = urls.sparkSession
    held = spark.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "h string, p string, rule string, action string")
    most = F.greatest(F.size(F.split("host", r"\.")), F.lit(1))
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda i: F.concat_ws(".", F.slice(F.split("host", r"\."), -i, i)))
    starts = F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("p")) for n in sorted({len(r[2]) for r in rules})])
    numbered = urls.withColumn("_row", F.monotonically_increasing_id())
    keys = numbered.select("_row", F.explode(suffixes).alias("h"), starts.alias("s")).select("_row", "h", F.explode("s").alias("s")).where(F.length("s.p") == F.col("s.n"))
    best = keys.select("_row", "h", "s.p").join(held, ["h", "p"]).groupBy("_row").agg(F.min_by(F.struct("rule", "action"), F.struct(-F.length("rule"), "rule", "action")).alias("fit"))
    return numbered.join(best, "_row", "left").drop("_row")


def judge(pages: DataFrame, labelled: DataFrame | Model, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, most_inline: int = 100) -> DataFrame:
    """`(page_id, host, path, rule, verdict, bad)` for every row; `labelled`: urls with labels, or what `fit` made of them."""
    model = labelled if isinstance(labelled, Model) else fit(labelled)
    urls = lexical(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")))
    ruled = (_by_expression if len(rules) <= most_inline else _by_join)(urls, rules)
    scored = model.featured(ruled).withColumn("bad", model.bad())
    own = F.when(F.col("bad") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", own).alias("verdict"), "bad")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls name their document by language and number; a label of low quality or of toxic text makes the url bad."""
    number = F.expr("try_cast(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) as bigint)")
    return pages.select("url", number.alias("doc_id")).where("doc_id is not null").join(labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")), "doc_id").select("url", "bad")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))
