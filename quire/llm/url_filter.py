"""URL filters: rules first, gradient-boosted trees for the rest.

Labelled URLs are those that a rule decides.  The trees are grown from
aggregated histograms of binned lexical features, one grouped aggregation per
level; a grown tree is a CASE expression, so scoring stays in generated code.
Only DataFrame functions are used; the driver sees histograms (nodes x features
x bins), never rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import ascii_lower, materialize

#: The rules of the contract, as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "suffix_rate", "suffix2_rate", "segment_rate")
#: Characters that the entropy tells apart; all others count as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./:-_?&=%#+~"
#: g and h are summed as integers, so that sums do not depend on their order.
SCALE = 1 << 24


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000  # labelled rows the trees are fitted on, lowest hash first
    trees: int = 8
    depth: int = 3
    bins: int = 16
    rate: float = 0.4
    l2: float = 1.0
    prior_weight: float = 20.0  # smoothing of suffix statistics


@dataclass
class Model:
    edges: dict = field(default_factory=dict)  # feature -> ascending thresholds
    trees: list = field(default_factory=list)  # {node: (feature, bin) | value}
    base: float = 0.0
    prior: float = 0.5


def split_url(url):
    """host and path of a url column, by the contract's definition."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def match_rule(host, path, rules=RULES):
    """struct(rule, verdict) of the longest fitting rule, else null.

    Rules are tried longest first (ties: longer host, then code points)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(df: DataFrame) -> DataFrame:
    """Add the features that need the url alone, and the keys of the suffix statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    low = ascii_lower(url)
    n = F.length(url).cast("double")

    def count(c, text=low):
        return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))

    safe = F.greatest(n, F.lit(1.0))
    seen = [count(c) for c in ALPHABET]
    total = seen[0]
    for x in seen[1:]:
        total = total + x

    def term(x):
        p = x.cast("double") / safe
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    entropy = term(n - total)
    for x in seen:
        entropy = entropy + term(x)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    # a ? behind the first # is part of the fragment
    front = F.substring_index(url, "#", 1)
    query = F.when(F.instr(front, "?") > 0, F.substring(front, F.instr(front, "?") + 1, F.length(front))).otherwise(F.lit(""))
    return df.select(
        "*",
        n.alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count("/", F.col("path")).cast("double").alias("depth"),
        (digits / safe).alias("digit_ratio"),
        # rounded, so that a bin does not depend on the order of the sum
        F.round(entropy, 6).alias("entropy"),
        F.when(F.length(query) > 0, 1 + count("&", query)).otherwise(0).cast("double").alias("n_params"),
        F.when(F.length("host") > 0, 1 + count(".", F.col("host"))).otherwise(0).cast("double").alias("n_labels"),
        count("-").cast("double").alias("n_hyphens"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("suffix2"),
        F.regexp_extract("path", r"^/([^/]*)/", 1).alias("segment"),
    )


def with_rates(df: DataFrame, tables: dict, prior: float) -> DataFrame:
    """Join the smoothed block rates; an unseen key gets the prior."""
    for key, table in tables.items():
        df = df.join(table, key, "left").withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(prior)))
    return df


def bin_of(name: str, edges):
    """Index of the bin: the number of edges below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (F.col(name) > F.lit(float(e))).cast("int")
    return out


def tree_value(tree: dict, node: int = 1):
    """A grown tree as a column over the bin columns ``b_<feature>``."""
    at = tree[node]
    if not isinstance(at, tuple):
        return F.lit(float(at))
    feature, cut = at
    return F.when(F.col(f"b_{feature}") <= cut, tree_value(tree, 2 * node)).otherwise(tree_value(tree, 2 * node + 1))


def margin(model: Model):
    out = F.lit(float(model.base))
    for t in model.trees:
        out = out + tree_value(t)
    return out


def node_of(tree: dict, level: int, node: int = 1):
    """The node of ``level`` that a row falls in, as a column."""
    if level == 0 or not isinstance(tree.get(node), tuple):
        return F.lit(node)
    feature, cut = tree[node]
    return F.when(F.col(f"b_{feature}") <= cut, node_of(tree, level - 1, 2 * node)).otherwise(node_of(tree, level - 1, 2 * node + 1))


def best_splits(hist: list, s: Settings) -> dict:
    """{node: (split or None, value, (left value, right value))} from rows (node, feature, bin, g, h)."""
    by: dict = {}
    for node, f, b, g, h in hist:
        by.setdefault(node, {}).setdefault(f, {})[b] = (g / SCALE, h / SCALE)
    out = {}
    for node, features in by.items():
        some = next(iter(features.values()))
        g_all, h_all = sum(x[0] for x in some.values()), sum(x[1] for x in some.values())
        best, gain_at, sides = None, 1e-6, None
        for f in sorted(features):
            g = h = 0.0
            for b in sorted(features[f])[:-1]:
                g, h = g + features[f][b][0], h + features[f][b][1]
                gain = g * g / (h + s.l2) + (g_all - g) ** 2 / (h_all - h + s.l2) - g_all**2 / (h_all + s.l2)
                if gain > gain_at + 1e-9:
                    best, gain_at, sides = (FEATURES[f], b), gain, ((g, h), (g_all - g, h_all - h))
        value = lambda gh: -s.rate * gh[0] / (gh[1] + s.l2)
        out[node] = (best, value((g_all, h_all)), tuple(map(value, sides)) if best else None)
    return out


def fit(labelled: DataFrame, s: Settings = Settings()) -> tuple[Model, dict]:
    """Grow the trees on ``labelled(key, y, <lexical columns>)``; y is 1 to block.

    ``s.sample_rows`` bounds the rows (lowest hash of the key first); the suffix
    statistics cover all labelled rows."""
    import math

    model = Model()
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return model, {}
    model.prior = (ones + 1.0) / (n + 2.0)
    model.base = math.log(model.prior / (1 - model.prior))
    tables = {
        key: materialize(
            labelled.groupBy(key).agg(((F.sum("y") + s.prior_weight * model.prior) / (F.count("*") + s.prior_weight)).alias(f"{key}_rate"))
        )
        for key in ("suffix", "suffix2", "segment")
    }
    sample = materialize(
        with_rates(labelled.orderBy(F.xxhash64("key"), "key").limit(s.sample_rows), tables, model.prior).select("y", *FEATURES)
    )
    cuts = [i / s.bins for i in range(1, s.bins)]
    row = sample.agg(*[F.percentile(f, F.array(*[F.lit(c) for c in cuts])).alias(f) for f in FEATURES]).first()
    model.edges = {f: sorted(set(row[f])) for f in FEATURES}
    binned = materialize(sample.select("y", *[bin_of(f, model.edges[f]).cast("int").alias(f"b_{f}") for f in FEATURES]).coalesce(1))
    for _ in range(s.trees):
        tree: dict = {}
        p = 1 / (1 + F.exp(-margin(model)))
        rows = binned.select("*", p.alias("p"))
        for level in range(s.depth):
            hist = (
                rows.select(
                    node_of(tree, level).alias("node"),
                    F.round((F.col("p") - F.col("y")) * SCALE).cast("long").alias("g"),
                    F.round(F.col("p") * (1 - F.col("p")) * SCALE).cast("long").alias("h"),
                    F.posexplode(F.array(*[F.col(f"b_{f}") for f in FEATURES])).alias("f", "bin"),
                )
                .where(F.col("node") >= 1 << level)
                .groupBy("node", "f", "bin")
                .agg(F.sum("g"), F.sum("h"))
                .collect()
            )
            for node, (split, value, sides) in best_splits([tuple(r) for r in hist], s).items():
                tree[node] = split or value
                if split and level == s.depth - 1:
                    # the last level's leaves follow from the sums on either side of the split
                    tree[2 * node], tree[2 * node + 1] = sides
            if not any(node >> level == 1 and isinstance(x, tuple) for node, x in tree.items()):
                break
        model.trees.append(tree)
    return model, tables


def judge_urls(pages: DataFrame, rules=RULES, settings: Settings = Settings()) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score`` for every row of ``pages``.

    score is the trees' probability to block, for every row; the verdict is the
    rule's where one fits, else block if score >= 0.5.

    * Null url, or none with ``://``: empty host and path, no rule fits.  A very
      long url is judged whole.
    * Repeated rows are judged alike; a label counts once per row.
    * Without any labelled row the score is 0.5 and the verdict allow; an empty
      table gives an empty one.  Other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", "url").select("*", host.alias("host"), path.alias("path"))
    ruled = parsed.select("*", match_rule(F.col("host"), F.col("path"), rules).alias("m"))
    table = materialize(lexical(ruled))
    labelled = table.where("m is not null").select(F.coalesce("url", F.lit("")).alias("key"), (F.col("m.verdict") == "block").cast("int").alias("y"), *[c for c in table.columns if c not in ("page_id", "url", "m")])
    model, tables = fit(labelled, settings)
    if not model.trees:
        return table.select("page_id", "url", "host", "path", "m.rule", F.coalesce("m.verdict", F.lit("allow")).alias("verdict"), F.lit(0.5).alias("score"))
    scored = with_rates(table, tables, model.prior).select(
        "page_id", "url", "host", "path", "m", *[bin_of(f, model.edges[f]).alias(f"b_{f}") for f in FEATURES]
    )
    score = 1 / (1 + F.exp(-margin(model)))
    return scored.select("page_id", "url", "host", "path", F.col("m.rule").alias("rule"), score.alias("score"), F.col("m.verdict").alias("v")).select(
        "page_id", "url", "host", "path", "rule", F.coalesce("v", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )


def op4_url_filters(spark, sf_dir):
    from quire.llm.store import read_table

    return judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))
