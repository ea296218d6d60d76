"""Log-message categorization: tokens, weights, similarity to known categories, reverse searches.

Categories are those token lists that no category before them resembles.  Only distinct token lists need comparing, by their
first arrival.  No group of rows holds a partition: the earliest undecided lists, bounded in number, are gone
through in order, which decides each of them, as everything earlier is decided; the new categories then take what
resembles them out of all later lists at once, by a set-similarity join over rare pairs of tokens side by side (over rare
tokens where a dictionary weighs them), and so on until no list is left.
Each list at last joins the most similar category that came before it, of equally similar ones the oldest.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.operators.skew import join_counted
from driftwell.sources.tables import dropped, written

UPPER, LOWER = 0.85, 0.7
#: Lists more similar than LOWER have this share of either's weight in common, as total weights differ by LOWER at most.
SHARED = 2 - 1 / LOWER
LISTS = 32_768  # lists that are gone through in order at a time, about
RANGES = 8192  # ranges of the order of arrival at most
EXAMPLE = 1000  # characters that are kept of an example
FREQUENT = 10_000  # tokens, or pairs of them, whose frequency is known to every task
BETWEEN = "\x1f"  # what parts the tokens of a pair
# English names of days and months and zone names that count as date words.
DATE_WORDS = [w for n in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December") for w in (n, n[:3])] + ["GMT", "UTC"]
TOKEN = r"[a-zA-Z0-9/]+(?:[_.\-]+[a-zA-Z0-9/]+)*"


def tokens_of(text: Column) -> Column:
    """Array of a message's tokens: first line, no leading digits, no pure hex, no date words."""
    line = F.element_at(F.split(F.coalesce(text, F.lit("")), "\n", 2), 1)
    found = F.regexp_extract_all(line, F.lit(f"({TOKEN})"), 1)
    dates = [w.lower() for w in DATE_WORDS]
    return F.filter(
        found,
        lambda t: (~t.rlike("^[0-9]")) & (~t.rlike("^(0[xX])?[0-9a-fA-F]*[0-9][0-9a-fA-F]*$")) & (~F.lower(t).isin(dates)) & (t != ""),
    )


def tokens_of_csv(line: Column) -> Column:
    """Array of the tokens that came ready in one line of comma-separated values, fields in quotes whole."""
    field = F.regexp_extract_all(F.concat(F.lit(","), F.coalesce(line, F.lit(""))), F.lit(',("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.filter(F.transform(field, lambda t: F.when(t.startswith('"'), F.replace(F.regexp_replace(t, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(t)), lambda t: t != "")


def pattern_counts(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """(pattern, n, least, most): rows by the first pattern that matches them, -1 for none, and the shortest and longest of them."""
    first = F.coalesce(*[F.when(F.col(text).rlike(p), i) for i, p in enumerate(patterns)], F.lit(-1))
    return df.groupBy(first.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(F.length(text)).alias("least"), F.max(F.length(text)).alias("most"))


def weights_of(tokens: list[str], words: frozenset[str] = frozenset(), verbs: frozenset[str] = frozenset()) -> list[int]:
    """1 a token; dictionary words 2 more (verbs 5), six times the extra from the third in a row."""
    out, run = [], 0
    for t in tokens:
        low = t.lower()
        known = len(t) >= 2 and low in words
        run = run + 1 if known else 0
        extra = (5 if low in verbs else 2) if known else 0
        out.append(1 + extra * (6 if run >= 3 else 1))
    return out


def weighted_distance(a: list[str], b: list[str], wa: list[int], wb: list[int]) -> int:
    """Edit distance over tokens: insertions and deletions cost a token's weight, changes the larger one."""
    if min(len(a), len(b)) > 24:
        names = {t: i for i, t in enumerate({*a, *b})}
        return long_distance(*(np.array([names[t] for t in x]) for x in (a, b)), np.array(wa), np.array(wb))
    row = [0]
    for w in wb:
        row.append(row[-1] + w)
    for t, w in zip(a, wa):
        above, row = row, [0] * len(row)
        row[0] = above[0] + w
        for j, (u, v) in enumerate(zip(b, wb), 1):
            row[j] = min(above[j] + w, row[j - 1] + v, above[j - 1] + (0 if t == u else max(w, v)))
    return row[-1]


def long_distance(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> int:
    """weighted_distance() of numbered tokens, a row at a time: insertions are a running minimum over the weights so far."""
    upto = np.concatenate([[0], np.cumsum(wb)])
    row = upto
    for t, w in zip(a, wa):
        best = row + w
        best[1:] = np.minimum(best[1:], row[:-1] + np.where(b == t, 0, np.maximum(wb, w)))
        row = np.minimum.accumulate(best - upto) + upto
    return int(row[-1])


def similarity(a: list[str], b: list[str], wa: list[int], wb: list[int]) -> float:
    """One less the distance's share of the larger weight; 0 where the tokens that only one of them has rule out more than LOWER."""
    most, mine, theirs = max(sum(wa), sum(wb), 1), set(a), set(b)
    alone = max(sum(w for t, w in zip(a, wa) if t not in theirs), sum(w for t, w in zip(b, wb) if t not in mine))
    if alone >= (1 - LOWER) * most + 1e-9:
        return 0.0
    return 1 - weighted_distance(a, b, wa, wb) / most


def rare_tokens(tokens: list[str], weights: list[int], frequency: dict[str, int]) -> list[str]:
    """The distinct tokens, rarest first, down to where all that follow weigh less than SHARED: similar lists share one of them.

    An empty list has the empty token alone.
    """
    held: dict[str, int] = {}
    for t, w in zip(tokens, weights):
        held[t] = held.get(t, 0) + w
    left, out, total = sum(weights), [], sum(weights)
    for t in sorted(held, key=lambda t: (frequency.get(t, 0), t)):
        if left < SHARED * total - 1e-9:
            break
        out.append(t)
        left -= held[t]
    return out or [""]


def rare_pairs(tokens: list[str], frequency: dict[str, int]) -> list[str]:
    """Where every token weighs 1: enough of the rarest pairs of tokens side by side that similar lists share one of them.

    Both ends count as tokens, and repeated pairs are numbered.  A step of the edit distance takes at most two pairs from the longer
    of two lists, so of m + 1 pairs all but twice the steps that LOWER allows are in both.  An empty list has the empty token alone.
    """
    if not tokens:
        return [""]
    ends, held, named = ["", *tokens, ""], {}, []
    for a, b in zip(ends, ends[1:]):
        pair = a + BETWEEN + b
        held[pair] = nth = held.get(pair, 0) + 1
        named.append((frequency.get(pair, 0), pair, nth))
    n = len(tokens)
    shared = min(m + 1 - 2 * int((1 - LOWER) * m + 1e-9) for m in range(n, int(n / LOWER + 1e-9) + 1))
    return [f"{pair}{BETWEEN}{nth}" for _, pair, nth in sorted(named)[: n + 2 - shared]]


class Category:
    def __init__(self, tokens: list[str], weights: list[int]):
        self.base, self.weights, self.count = tokens, weights, 0
        self.common, self.longest = list(tokens), 0
        self.total = sum(weights)

    def take(self, tokens: list[str], length: int) -> None:
        self.count += 1
        self.longest = max(self.longest, length)
        if self.common != tokens:
            at, kept = 0, []
            for t in self.common:
                if t in tokens[at:]:
                    at = tokens.index(t, at) + 1
                    kept.append(t)
            self.common = kept

    def reverse_search(self) -> tuple[str, str]:
        """(terms, regex) that find the category's members again."""
        if not self.common:
            return "", ".*"
        return " ".join(self.common), ".*?" + ".+?".join(map(re.escape, self.common)) + ".*"


class Categorizer:
    """Known categories and one state in order of arrival.

    by_count: categories are tried from the most matched down, and one above the upper threshold is taken at once.
    Otherwise the most similar is taken, of equally similar ones the oldest, which needs no counts.  Only
    categories found under the message's rarer tokens are compared: those left out together weigh too little.
    """

    def __init__(self, words: frozenset[str] = frozenset(), verbs: frozenset[str] = frozenset(), by_count: bool = True):
        self.categories: list[Category] = []
        self.under: dict[str, list[int]] = {}
        self.words, self.verbs, self.met, self.by_count = words, verbs, {}, by_count

    def candidates(self, tokens: list[str], weights: list[int], total: int) -> list[int]:
        held: dict[str, int] = {}
        for t, w in zip(tokens, weights):
            held[t] = held.get(t, 0) + w
        skipped, found = 0, set()
        for t in sorted(held, key=lambda t: -len(self.under.get(t, ()))):
            if skipped + held[t] < SHARED * total - 1e-9:
                skipped += held[t]
            else:
                found.update(self.under.get(t, ()))
        return sorted(found, key=lambda i: (-self.categories[i].count if self.by_count else 0, i))

    def match(self, tokens: list[str], weights: list[int]) -> int | None:
        if not tokens:
            return next((i for i, c in enumerate(self.categories) if not c.base), None)
        total, best, top = sum(weights), None, LOWER
        for i in self.candidates(tokens, weights, total):
            c = self.categories[i]
            if min(total, c.total) < LOWER * max(total, c.total):
                continue
            s = similarity(tokens, c.base, weights, c.weights)
            if s > top:
                best, top = i, s
                if self.by_count and s > UPPER:
                    break
        return best

    def category(self, tokens: list[str], length: int) -> int:
        """The number, from 1, of the message's category; a new one if none is similar enough."""
        key = tuple(tokens)
        best = self.met.get(key)
        if best is None:
            weights = weights_of(tokens, self.words, self.verbs)
            best = self.match(tokens, weights)
            if best is None:
                best = len(self.categories)
                self.categories.append(Category(tokens, weights))
                for t in set(tokens):
                    self.under.setdefault(t, []).append(best)
            self.met[key] = best
        self.categories[best].take(tokens, length)
        return best + 1


def token_lists(rows: DataFrame, words: frozenset[str], verbs: frozenset[str]) -> DataFrame:
    """(partition, tokens, n, weights, rare, pos, range): the distinct lists; pos rises with first arrival, in ranges of it.

    rare is in one order of all tokens, or pairs of them, rarest first; of similar lists both have one of them.
    """
    lists = written(rows.groupBy("partition", "tokens").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    # without a dictionary all tokens weigh 1, and pairs of tokens, which are much rarer, tell lists apart
    token = lambda i: F.coalesce(F.get("tokens", i), F.lit(""))
    pairs = F.transform(F.sequence(F.lit(0), F.size("tokens")), lambda i: F.concat(token(i - 1), F.lit(BETWEEN), token(i)))
    told = F.array_distinct("tokens" if words else pairs)
    often = lists.select(F.explode(told).alias("t")).groupBy("t").count().where("count > 1").orderBy(F.desc("count"), "t").limit(FREQUENT).collect()
    known = rows.sparkSession.sparkContext.broadcast({r["t"]: r["count"] for r in often})

    def run(batches):
        for pdf in batches:
            tokens = [list(t) for t in pdf["tokens"]]
            weights = [weights_of(t, words, verbs) for t in tokens]
            rare = [rare_tokens(t, w, known.value) if words else rare_pairs(t, known.value) for t, w in zip(tokens, weights)]
            yield pdf.assign(weights=weights, rare=rare)

    kind = lists.schema["first"].dataType.simpleString()
    wide = lists.mapInPandas(run, f"partition string, tokens array<string>, first {kind}, n long, weights array<int>, rare array<string>")
    order = ["first", "partition", "tokens"]
    ranges = min(RANGES, lists.count() // (LISTS // 4) + 1)
    ordered = wide.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    out = written(ordered.drop("first").withColumn("range", F.shiftright("pos", 33).cast("int")))
    dropped(lists)
    return out


def alike(lists: DataFrame, categories: DataFrame) -> DataFrame:
    """(pos, category_pos, similarity): lists with the categories before them that they resemble.

    Lists meet by narrow rows, one a rare token; what they hold comes to the pairs that met.  Joins are told to merge: Spark sizes a
    table as before its explode, and by its compressed files, so it would send the lists through the driver.
    """
    total = F.aggregate("weights", F.lit(0), lambda x, y: x + y)
    # one number a token; what another token's number joins is compared like any other pair
    rows = lambda df, pos, total_of: df.select(F.col("pos").alias(pos), total.alias(total_of), F.explode("rare").alias("t"), "partition").select(
        pos, total_of, F.xxhash64("partition", "t").alias("t")
    )
    held = lambda df, *names: df.select(*[F.col(c).alias(n) for c, n in zip(("pos", "tokens", "weights", "partition"), names)]).hint("merge")
    met = rows(lists, "pos", "total").join(rows(categories, "category_pos", "other").hint("merge"), "t").where("category_pos < pos")
    fit = met.where(F.least("total", "other") >= LOWER * F.greatest("total", "other")).select("pos", "category_pos").distinct()
    pairs = fit.join(held(lists, "pos", "a", "wa", "p"), "pos").join(held(categories, "category_pos", "b", "wb", "q"), "category_pos").where("p = q")

    def compare(a: pd.Series, b: pd.Series, wa: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([similarity(list(x), list(y), list(v), list(w)) for x, y, v, w in zip(a, b, wa, wb)], dtype=float)

    s = F.pandas_udf(compare, "double")("a", "b", "wa", "wb")
    return pairs.select("pos", "category_pos", s.alias("similarity")).where(F.col("similarity") > LOWER)


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """One partition's lists, each with the position of its category, which is its own for a new one."""
    pdf = pdf.sort_values("pos")
    categories: list[tuple[int, list[str], list[int], int]] = []
    under: dict[str, list[int]] = {}
    found = []
    for pos, tokens, weights, rare in zip(pdf["pos"], pdf["tokens"], pdf["weights"], pdf["rare"]):
        tokens, weights, total, best, top = list(tokens), list(weights), int(sum(weights)), pos, LOWER
        for i in sorted({i for t in rare for i in under.get(t, ())}):
            at, base, theirs, other = categories[i]
            if min(total, other) < LOWER * max(total, other):
                continue
            s = similarity(tokens, base, weights, theirs)
            if s > top:
                best, top = at, s
        if best == pos:
            for t in rare:
                under.setdefault(t, []).append(len(categories))
            categories.append((pos, tokens, weights, total))
        found.append(best)
    return pdf.assign(category_pos=found)


def decided_lists(lists: DataFrame, window: int = LISTS) -> tuple[DataFrame, bool]:
    """(partition, tokens, weights, rare, pos, category_pos) of the lists that no category of an earlier window resembles; whether that is all of them.

    Those whose category is their own are all categories, exactly as one state in order would find them.
    """
    columns = ["partition", "tokens", "weights", "rare", "pos"]
    schema = "partition string, tokens array<string>, weights array<int>, rare array<string>, pos long, category_pos long"
    left, found = lists, []
    while True:
        sizes = left.groupBy("range").count().orderBy("range").collect()  # RANGES at most
        if not sizes:
            break
        upto, n = sizes[0]["range"], sizes[0]["count"]
        for r in sizes[1:]:
            if n + r["count"] > window:
                break
            upto, n = r["range"], n + r["count"]
        found.append(written(left.where(F.col("range") <= upto).select(*columns).groupBy("partition").applyInPandas(in_order, schema)))
        if upto == sizes[-1]["range"]:
            break
        later = left.where(F.col("range") > upto)
        rest = written(later.join(alike(later, found[-1].where("pos = category_pos")).select("pos").distinct(), "pos", "left_anti"))
        if left is not lists:
            dropped(left)
        left = rest
    if left is not lists:
        dropped(left)
    if len(found) < 2:
        return found[0] if found else written(lists.select(*columns, F.col("pos").alias("category_pos"))), True
    out = written(*found)
    dropped(*found)
    return out, False


def numbered_categories(categories: DataFrame) -> DataFrame:
    """(category_pos, category, global_category): categories counted from 1 in their partition and over all, range by range of the order of arrival."""
    c = categories.select("partition", F.col("pos").alias("category_pos"), F.shiftright("pos", 33).alias("r"))
    sizes = c.groupBy("partition", "r").count()
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda w: F.coalesce(F.sum("count").over(w), F.lit(0))
    own = sizes.select("partition", "r", start(upto("partition")).alias("before"))
    every = sizes.groupBy("r").agg(F.sum("count").alias("count")).select("r", start(upto(F.lit(0))).alias("before_all"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("category_pos"))
    return c.withColumn("p", place("partition", "r")).withColumn("q", place("r")).join(own, ["partition", "r"]).join(every, "r").select(
        "category_pos", (F.col("p") + F.col("before")).cast("int").alias("category"), (F.col("q") + F.col("before_all")).alias("global_category")
    )


def categorize(
    df: DataFrame, key: str, text: str, order: list[str], partition: str | None = None, patterns: tuple[str, ...] = (),
    words: frozenset[str] = frozenset(), verbs: frozenset[str] = frozenset(), window: int = LISTS,
) -> DataFrame:
    """(partition, key, category, global_category) of every message.

    category counts a partition's categories from 1 in order of arrival, global_category those of all partitions.
    """
    c = F.col(text).cast("string")
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    part = F.coalesce(F.col(partition).cast("string"), F.lit("")) if partition else F.lit("")
    rows = df.select(part.alias("partition"), F.col(key).alias("key"), tokens_of(c).alias("tokens"), F.struct(*order).alias("at"))
    lists = token_lists(rows, words, verbs)
    decided, whole = decided_lists(lists, window)
    categories = decided.where("pos = category_pos")
    assigned = decided.select("pos", "category_pos")
    of = decided
    if not whole:
        near = alike(lists.join(assigned.select("pos"), "pos", "left_anti"), categories)
        of = written(assigned, near.groupBy("pos").agg(F.max_by("category_pos", F.struct("similarity", -F.col("category_pos"))).alias("category_pos")))
    named = written(lists.select("partition", "tokens", "n", "pos").join(of.select("pos", "category_pos").hint("merge"), "pos").join(numbered_categories(categories).hint("merge"), "category_pos").select("partition", "tokens", "n", "category", "global_category"))
    dropped(lists, decided, *([] if whole else [of]))
    return join_counted(rows, named, ["partition", "tokens"], "n", ["key"], wide=True).select("partition", "key", "category", "global_category")


def category_definitions(assigned: DataFrame, messages: DataFrame, key: str, text: str, examples: int = 4) -> DataFrame:
    """(partition, category, count, terms, regex, max_length, examples) of each category."""
    rows = assigned.join(messages.select(F.col(key).alias("key"), F.col(text).alias("_t")).hint("merge"), "key").withColumn("tokens", tokens_of(F.col("_t")))
    counts = rows.groupBy("partition", "category").agg(F.count(F.lit(1)).alias("count"), F.max(F.length("_t")).alias("longest"), F.min(F.struct("key", "tokens")).getField("tokens").alias("base"))
    distinct = rows.select("partition", "category", F.substring("_t", 1, EXAMPLE).alias("e")).where("e is not null").distinct()
    place = F.row_number().over(Window.partitionBy("partition", "category").orderBy("e"))
    some = distinct.withColumn("_p", place).where(F.col("_p") <= examples).groupBy("partition", "category").agg(F.array_sort(F.collect_list("e")).alias("examples"))
    held = rows.select("partition", "category", "key", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("partition", "category", "t").agg(F.count(F.lit(1)).alias("n"))
    common = held.join(counts.select("partition", "category", "count").hint("merge"), ["partition", "category"]).where("n = count").groupBy("partition", "category").agg(F.collect_set("t").alias("common"))
    out = counts.join(some.hint("merge"), ["partition", "category"], "left").join(common.hint("merge"), ["partition", "category"], "left")
    kept = F.filter("base", lambda t: F.array_contains(F.coalesce("common", F.array().cast("array<string>")), t))
    quoted = F.transform(kept, lambda t: F.regexp_replace(t, r"([.\-/])", r"\\$1"))
    return out.select(
        "partition", "category", "count",
        F.array_join(kept, " ").alias("terms"),
        F.when(F.size(kept) == 0, ".*").otherwise(F.concat(F.lit(".*?"), F.array_join(quoted, ".+?"), F.lit(".*"))).alias("regex"),
        F.ceil(F.col("longest") * 1.1).cast("int").alias("max_length"),
        "examples",
    )


def categorization_status(counts: DataFrame, dead: int = 0) -> DataFrame:
    """One row: status ok or warn, from a table (category, count)."""
    a = counts.agg(F.sum("count").alias("messages"), F.count(F.lit(1)).alias("categories"), F.count_if(F.col("count") == 1).alias("rare"))
    often = counts.join(F.broadcast(a.select("messages"))).agg(F.count_if((F.col("count") > 1) & (F.col("count") * 100 > F.col("messages"))).cast("int").alias("frequent"))
    a = a.join(F.broadcast(often))
    warn = (F.col("messages") >= 100) & (
        (F.col("categories") == 1) | (F.col("rare") > 0.9 * F.col("categories")) | (F.col("categories") > 0.5 * F.col("messages"))
        | (F.col("frequent") == 0) | (F.lit(dead) > 0.5 * F.col("categories"))
    )
    return a.select("messages", "categories", "rare", "frequent", F.when(warn, "warn").otherwise("ok").alias("status"))
