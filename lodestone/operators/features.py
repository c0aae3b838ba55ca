"""Features of tokens and texts, dictionaries, distances, gains, estimators and least squares."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.learn import numbered


def letters(text: Column) -> Column:
    """Runs of letters, case kept; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.array().cast("array<string>"))


def character_grams(text: Column, n: int, borders: bool = False) -> Column:
    """Pieces of n characters from every place but the last that has one, in order; with `borders` '>' and '<' stand around the
    text. Found by one pass of a pattern, which begins no piece inside a surrogate pair, so that long texts cost their length."""
    whole = F.concat(F.lit(">"), text, F.lit("<")) if borders else text
    every = F.coalesce(F.regexp_extract_all(whole, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1)), F.array().cast("array<string>"))
    return F.when(F.size(every) > 1, F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def token_grams(tokens: Column, sizes: list[int]) -> Column:
    """At each place the n-grams that end there, for every size that fits, joined by _."""
    ending = lambda i: F.filter(F.transform(F.array(*[F.lit(s) for s in sizes]), lambda s: F.when(i >= s, F.array_join(F.slice(tokens, F.greatest(i - s + 1, F.lit(1)), s), "_"))), lambda g: g.isNotNull())
    return F.when(F.size(tokens) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), ending))).otherwise(F.array().cast("array<string>"))


def token_features(token: Column, place: Column, prefix: int = 3, suffix: int = 3, patterns: dict[str, str] | None = None) -> Column:
    """Names of the features a token has: its text, prefix and suffix (of longer tokens), FIRST, and each pattern that matches it whole."""
    found = [F.concat(F.lit("W="), token), F.when(F.length(token) > prefix, F.concat(F.lit("P="), F.substring(token, 1, prefix)))]
    found += [F.when(F.length(token) > suffix, F.concat(F.lit("S="), F.right(token, F.lit(suffix)))), F.when(place == 0, F.lit("FIRST"))]
    found += [F.when(token.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in (patterns or {}).items()]
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def phrase_places(tokens: DataFrame, lexicon: DataFrame, longest: int, key: str = "doc_id") -> DataFrame:
    """(key, place, phrase, n): of (key, tokens) every place, from 0, where a phrase of `lexicon` (phrase: words joined by a
    blank, at most `longest`) begins; the longest where several do. One equi-join on the phrase."""
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("tokens") - i + 1)), lambda s: F.struct((i - 1).alias("place"), s.alias("n"), F.array_join(F.slice("tokens", i, s), " ").alias("phrase")))
    every = tokens.filter(F.size("tokens") > 0).select(key, F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("tokens")), runs))).alias("x")).select(key, "x.*")
    found = every.join(lexicon.select("phrase").distinct(), "phrase", "left_semi")
    return found.groupBy(key, "place").agg(F.max_by("phrase", "n").alias("phrase"), F.max("n").alias("n"))


def remembered(rows: DataFrame, key: str, order: str, label: str, background: str) -> DataFrame:
    """`rows` with remembered: the last label up to the row that isn't the background, the background before any."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(label) != background, F.col(label)), ignorenulls=True).over(w)
    return rows.withColumn("remembered", F.coalesce(last, F.lit(background)))


def log_scaled(n: Column) -> Column:
    """Values of one or more become their logarithm plus one."""
    return F.when(n >= 1, F.log(n.cast("double")) + 1).otherwise(n.cast("double"))


def common_terms(counts: DataFrame, total: DataFrame, share: float, key: str = "doc_id") -> DataFrame:
    """(term, df) of terms in over `share` of all rows: a stop list; `total` is one row (n_docs)."""
    df = counts.groupBy("term").agg(F.count_distinct(key).alias("df"))
    return df.crossJoin(F.broadcast(total)).filter(F.col("df") / F.col("n_docs") > share).select("term", "df")


def trimmed_features(counts: DataFrame, total: DataFrame, least: int = 1, least_docs: int = 1, share: float = 1.0, key: str = "doc_id") -> DataFrame:
    """(term, n, df) of terms with at least `least` occurrences in `least_docs` rows or more, and in at most `share` of all rows."""
    both = counts.groupBy("term").agg(F.sum("n").alias("n"), F.count_distinct(key).alias("df"))
    kept = both.crossJoin(F.broadcast(total)).filter((F.col("n") >= least) & (F.col("df") >= least_docs) & (F.col("df") / F.col("n_docs") <= share))
    return kept.select("term", "n", "df")


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(column, id): consecutive numbers from 0 over the distinct values in their order, without a window over everything."""
    return numbered(values.select(column).filter(F.col(column).isNotNull()).distinct(), column).select(column, (F.col("number") - 1).cast("long").alias("id"))


def first_mentions(tokens: DataFrame, key: str, order: str, token: str = "token") -> DataFrame:
    """`tokens` with first: the place of the token's first mention in its sequence, and repeated: whether this is a later one."""
    first = F.min(order).over(Window.partitionBy(key, token))
    return tokens.withColumn("first", first).withColumn("repeated", F.col(order) > F.col("first"))


def parsed_features(text: Column) -> Column:
    """A map of blank-separated name=value pairs, names alone weigh 1; a name's last value counts."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r",?\s+"), lambda p: F.length(p) > 0)
    pair = lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.when(p.contains("="), F.split_part(p, F.lit("="), F.lit(2)).try_cast("double")).otherwise(1.0).alias("v"))
    pairs = F.transform(parts, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def distances(a: Column, b: Column, power: float = 3.0) -> dict[str, Column]:
    """Manhattan, Euclidean, greatest-coordinate, Minkowski and 1 - cosine distances of two arrays of one length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    size = F.sqrt(total(F.transform(a, lambda x: x * x)) * total(F.transform(b, lambda x: x * x)))
    return {
        "manhattan": total(gap),
        "euclidean": F.sqrt(total(F.transform(gap, lambda g: g * g))),
        "greatest": F.array_max(gap),
        "minkowski": F.pow(total(F.transform(gap, lambda g: F.pow(g, F.lit(power)))), F.lit(1 / power)),
        "angular": 1 - F.when(size == 0, 0.0).otherwise(dot / size),
    }


def _h(*parts: Column) -> Column:
    """Entropy in bits of counts."""
    whole = sum(parts[1:], parts[0])
    return sum((F.when(p > 0, -(p / whole) * F.log2(p / whole)).otherwise(0.0) for p in parts), F.lit(0.0))


def label_gains(counts: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(label, term, n, gain, ratio): for each label against the rest, the information gain in bits of a term's presence, and
    its ratio to the entropy of presence (0 where that is 0). Pairs of a label and a term that meet in no row are left out.
    """
    rows = counts.select(key, "term").distinct().join(labels.select(key, "label"), key)
    both = rows.groupBy("label", "term").agg(F.count("*").alias("n"))
    per_term = both.groupBy("term").agg(F.sum("n").alias("t"))
    per_label = labels.filter("label is not null").groupBy("label").agg(F.count("*").alias("l"))
    whole = F.broadcast(per_label.agg(F.sum("l").alias("all")))  # one row
    x = both.join(per_term, "term").join(per_label, "label").crossJoin(whole)
    n, t, size, every = (F.col(c).cast("double") for c in ("n", "t", "l", "all"))
    rest = every - t
    inside = F.when(t > 0, t / every * _h(n, t - n)).otherwise(0.0)
    outside = F.when(rest > 0, rest / every * _h(size - n, rest - size + n)).otherwise(0.0)
    gain, split = _h(size, every - size) - inside - outside, _h(t, rest)
    gain = F.when(gain > 0, gain).otherwise(0.0)  # rounding can leave less than nothing
    return x.select("label", "term", "n", gain.alias("gain"), F.when(split > 0, gain / split).otherwise(0.0).alias("ratio"))


def multinomials(counts: DataFrame, m: float = 1.0) -> DataFrame:
    """(term, n, likeliest, laplace, m_estimate) of (term, n): n / N, (n + 1) / (N + V) and (n + m / V) / (N + m)."""
    size = F.broadcast(counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_v")))  # one row
    n, every, v = F.col("n"), F.col("_all"), F.col("_v")
    return counts.crossJoin(size).select("term", "n", (n / every).alias("likeliest"), ((n + 1) / (every + v)).alias("laplace"), ((n + m / v) / (every + m)).alias("m_estimate"))


def least_squares(rows: DataFrame, features: list[str], target: str, ridge: float = 0.0) -> dict[str, float]:
    """Weights by feature and `intercept`, by the normal equations: one aggregate of the products, solved on the driver, whose
    size is the square of the number of features. Rows with a null are left out; the intercept isn't shrunk."""
    names = [*features, None]
    value = lambda c: F.lit(1.0) if c is None else F.col(c).cast("double")
    whole = rows.dropna(subset=[*features, target])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = whole.agg(*(F.sum(value(names[i]) * value(names[j])).alias(f"x{i}_{j}") for i, j in pairs), *(F.sum(value(c) * value(target)).alias(f"y{i}") for i, c in enumerate(names))).first()
    if sums[f"x{len(features)}_{len(features)}"] is None:
        raise ValueError("no row without a null")
    a, b = np.zeros((len(names), len(names))), np.array([sums[f"y{i}"] for i in range(len(names))])
    for i, j in pairs:
        a[i, j] = a[j, i] = sums[f"x{i}_{j}"]
    a[range(len(features)), range(len(features))] += ridge
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    return {**{c: float(x) for c, x in zip(features, w, strict=False)}, "intercept": float(w[-1])}


def sparse_moments(values: DataFrame, total: DataFrame, feature: str, value: str) -> DataFrame:
    """(feature, n, mean, variance) over all rows of which `values` holds the ones that are not zero; `total` is one row (n_docs)."""
    s = values.groupBy(feature).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("_s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("_q")).crossJoin(F.broadcast(total))
    mean = F.col("_s") / F.col("n_docs")
    return s.select(feature, "n", mean.alias("mean"), F.when(F.col("n_docs") > 1, (F.col("_q") - F.col("n_docs") * mean * mean) / (F.col("n_docs") - 1)).alias("variance"))


def tagged_tokens(text: Column, background: str = "O", allowed: list[str] | None = None) -> Column:
    """Array of (token, tag): runs of letters with the tag that was opened last, `background` after a closing tag and before
    any. With `allowed`, other tags are passed over. Tags aren't nested; null gives an empty array."""
    pieces = F.coalesce(F.regexp_extract_all(text, F.lit("</?[A-Za-z][^<>]*>|[A-Za-z]+"), F.lit(0)), F.array().cast("array<string>"))
    name = lambda p: F.lower(F.regexp_extract(p, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    if allowed is not None:
        pieces = F.filter(pieces, lambda p: ~p.startswith("<") | name(p).isin(*allowed))
    tag = lambda p: F.when(p.startswith("</"), F.lit(background)).otherwise(name(p))
    # a tag closes the run of words before it: text between tags splits at tags, each part begins with its tag
    joined = F.split(F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<"), F.concat(F.lit("\n"), tag(p))).otherwise(p)), " "), "\n")
    runs = F.transform(joined, lambda r, i: F.struct(F.when(i == 0, F.lit(background)).otherwise(F.split_part(r, F.lit(" "), F.lit(1))).alias("tag"), F.when(i == 0, F.split(r, " ")).otherwise(F.slice(F.split(r, " "), F.lit(2), F.size(F.split(r, " ")))).alias("words")))
    return F.filter(F.flatten(F.transform(runs, lambda r: F.transform(r["words"], lambda w: F.struct(w.alias("token"), r["tag"].alias("tag"))))), lambda x: x["token"] != "")


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Text in lower case with every rule's phrase of whole words replaced in turn, longer phrases first; the blanks of what
    stands instead become _, and _ goes before a leading digit."""
    out = F.lower(text)
    for phrase, instead in sorted(rules, key=lambda r: (-len(r[0].split()), r[0])):
        name = "_".join(instead.split())
        name = "_" + name if name[:1].isdigit() else name
        pattern = r"\s+".join(re.escape(w) for w in phrase.lower().split())
        out = F.regexp_replace(out, rf"(?<![^\s]){pattern}(?![^\s])", name.replace("\\", r"\\").replace("$", r"\$"))
    return out


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., n, mean, variance, error, least, greatest): one pass; `error` is the standard error of the mean. Nulls don't count."""
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("error"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def dirichlet(cells: DataFrame, group: str, kind: str, n: str = "n", rounds: int = 2000, tolerance: float = 1e-6) -> dict:
    """The Dirichlet parameters by `kind` under which the groups' counts are likeliest, by fixed-point steps.

    The steps need only how many groups have a kind so many times, and how many have such a size: two histograms, which are
    gathered. They have a row for each distinct count of a kind, not for each group; kinds are few.
    """
    counts = cells.filter(F.col(n) > 0).groupBy(group, kind).agg(F.sum(n).alias("_n"))
    seen = [(r[kind], r["_n"], r["c"]) for r in counts.groupBy(kind, "_n").agg(F.count("*").alias("c")).collect()]
    sizes = [(r["s"], r["c"]) for r in counts.groupBy(group).agg(F.sum("_n").alias("s")).groupBy("s").agg(F.count("*").alias("c")).collect()]
    names = sorted({k for k, _, _ in seen}, key=str)
    a = dict.fromkeys(names, 1.0)
    rise = lambda x, m: float(np.sum(1.0 / (x + np.arange(int(m)))))
    for _ in range(rounds):
        total = sum(a.values())
        low = sum(c * rise(total, s) for s, c in sizes)
        top = dict.fromkeys(names, 0.0)
        for k, m, c in seen:
            top[k] += c * rise(a[k], m)
        new = {k: a[k] * top[k] / low for k in names}
        moved = max((abs(new[k] - a[k]) for k in names), default=0.0)
        a = new
        if moved < tolerance:
            break
    return a
