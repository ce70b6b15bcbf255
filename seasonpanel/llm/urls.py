"""URL filters: a rule list by host and path, and rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, stored

#: The item that marks a bad URL in a basket; no token starts with a blank.
BAD = " bad"
#: Least part of the labelled URLs that are bad and hold a combination, least part of those that hold it which is
#: bad, and how many times the part of bad ones among all labelled URLs that must be.
SUPPORT, CONFIDENCE, LIFT = 0.001, 0.5, 1.5
#: Bad URLs that a combination needs whatever the support says.
LEAST_BAD = 5
#: Tokens of a rule at most, and frequent tokens of a URL up to which FP-growth's trees, which know no such bound,
#: stay small. If a labelled URL has more, combinations are grown level by level instead, with the same rules.
RULE_TOKENS, TREE_TOKENS = 4, 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://`` up to ``?``, ``#`` or the end; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^[^?#]*", 0)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """The host as written, A-Z lower-cased; empty for null and for a URL without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^[^/]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """The path from its first slash on; empty if there is none."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/]*(.*)$", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, or null.

    A rule fits its host and all subdomains, for paths that start with its path. Longest is by the characters
    of host and path together, then of the host, then the text of the rule.
    """
    found = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The different tokens of a URL: scheme, domain suffixes, words of the host, path segments and query keys.

    All are lower-cased, and digits in path segments become one ``0``.
    """
    lower = F.lower(F.coalesce(url, F.lit("")))
    labels = F.split(F.regexp_replace(host(lower), r":\d*$", ""), r"\.")
    n = F.size(labels)

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind), F.lit(" "), v))

    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))
    words = F.flatten(F.transform(F.slice(labels, 1, F.greatest(n - 1, F.lit(1))), lambda x: F.split(x, "[-_]")))
    parts = F.transform(F.split(path(lower), "/"), lambda x: F.regexp_replace(x, r"\d+", "0"))
    keys = F.transform(F.split(F.regexp_extract(lower, r"\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    scheme = F.array(F.regexp_extract(lower, r"^([^:/?#]*)://", 1))
    return F.array_distinct(F.concat(*(named(k, v) for k, v in (("scheme", scheme), ("host", suffixes), ("word", words), ("path", parts), ("query", keys)))))


def _grown(baskets: DataFrame, least_bad: int) -> DataFrame:
    """(tokens, bad, n) of all combinations of ``baskets`` (bad, t) that can be rules that are not pruned.

    A row's combinations of k + 1 tokens are grown from its frequent ones of k by each later token. One
    that has the same rows as a part of it is no more confident than that part, nor is one with a part that is certain;
    so neither it nor what grows from it is a rule that stays, and it is left out.
    """
    held = baskets.groupBy(F.array_sort("t").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    held = held.select("n", "bad", F.array().cast("array<string>").alias("tokens"), F.col("t").alias("rest"))
    levels: list[DataFrame] = []
    for size in range(1, RULE_TOKENS + 1):
        held = held.select("n", "bad", "tokens", "rest", F.posexplode("rest").alias("_at", "token"))
        held = held.select("n", "bad", F.concat("tokens", F.array("token")).alias("tokens"), F.slice("rest", F.col("_at") + 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"))
        held = stored(held, "url-grown")
        counts = held.groupBy("tokens").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(F.col("bad") >= least_bad)
        if levels:
            parts = counts.select("tokens", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.filter("tokens", lambda x, i: i != k))).alias("part"))
            smaller = levels[-1].where("bad < n").select(F.col("tokens").alias("part"), F.col("n").alias("_n"))
            own = parts.join(smaller, "part").where("_n > n").groupBy("tokens").agg(F.count(F.lit(1)).alias("_parts")).where(F.col("_parts") == size)
            counts = counts.join(own.select("tokens"), "tokens")
        levels.append(stored(counts.select("tokens", "bad", "n"), "url-level"))
        held = held.join(levels[-1].where("bad < n").select("tokens"), "tokens", "left_semi").select("n", "bad", "tokens", "rest")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def mine_rules(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(tokens, least, n, bad, confidence): token combinations whose labelled URLs are mostly bad.

    Every labelled row takes part with all its tokens, repeated rows too; a null label counts as good. FP-growth finds the combinations
    that, together with the mark of a bad URL, reach the support; a combination's confidence is its count with the mark by its
    count. A rule is pruned if a part of its tokens is a rule that is at least as confident. ``least`` is the token that the
    fewest rows hold (ties: the smallest), the rule's key in the inverted index. No bad row: no rules.
    """
    rows = labelled.select(F.monotonically_increasing_id().alias("k"), tokens(F.col(url_col)).alias("found"), F.coalesce(F.col(bad_col).cast("boolean"), F.lit(False)).alias("bad"))
    rows = stored(rows, "url-labelled")
    marked = F.col("bad").cast("long")
    total, bad = rows.agg(F.count(F.lit(1)), F.sum(marked)).first()
    none = rows.sparkSession.createDataFrame([], "tokens array<string>, least string, n bigint, bad bigint, confidence double")
    if not bad:
        return none
    least_bad = max(LEAST_BAD, -(-int(support * 1e9) * total // 10**9))
    held = rows.select("k", "bad", F.explode("found").alias("token"))
    # a token in fewer bad rows is part of no rule; at most tokens of a row / support stay
    able = stored(held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(marked).alias("bad")).where(F.col("bad") >= least_bad), "url-tokens")
    baskets = stored(held.join(able.select("token"), "token").groupBy("k").agg(F.first("bad").alias("bad"), F.collect_list("token").alias("t")), "url-baskets")
    n_baskets, longest = baskets.agg(F.count(F.lit(1)), F.max(F.size("t"))).first()
    if not n_baskets:
        return none
    if longest > TREE_TOKENS:
        both = _grown(baskets, least_bad)
    else:
        items = F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t"))
        # the smallest part of all baskets that still means least_bad rows
        found = FPGrowth(itemsCol="items", minSupport=(least_bad - 0.5) / n_baskets).fit(baskets.select(items.alias("items"))).freqItemsets
        found = stored(found.where(F.size("items") <= RULE_TOKENS + 1).select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
        with_mark = found.where(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("bad"))
        both = with_mark.join(found.select(F.col("items").alias("tokens"), F.col("freq").alias("n")), "tokens")
    both = both.withColumn("confidence", F.col("bad") / F.col("n")).where((F.col("confidence") >= confidence) & (F.col("confidence") >= lift * bad / total))
    rules = stored(both, "url-rules")
    # every proper part of a rule's tokens, as the bits of a number
    numbered = rules.selectExpr("tokens", "confidence", "explode(sequence(0, shiftleft(1, size(tokens)) - 2)) as m")
    parts = numbered.where("m > 0").selectExpr("tokens as whole", "confidence as _own", "filter(tokens, (t, k) -> (shiftright(m, k) & 1) = 1) as tokens")
    beaten = parts.join(rules.select("tokens", "confidence"), "tokens").where("confidence >= _own").select(F.col("whole").alias("tokens")).distinct()
    kept = rules.join(beaten, "tokens", "left_anti")
    keyed = kept.select("*", F.explode("tokens").alias("token")).join(able.select("token", F.col("n").alias("_n")), "token")
    return keyed.groupBy("tokens").agg(F.min(F.struct("_n", "token"))["token"].alias("least"), F.first("n").alias("n"), F.first("bad").alias("bad"), F.first("confidence").alias("confidence"))


def matched(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``mined_rule`` and ``mined_confidence``: the most confident rule whose tokens a URL holds, or nulls.

    Ties: the rule whose tokens come first. The rules, each of which holds for a least part of the labelled URLs,
    are sent to all tasks as an inverted index by their rarest token.
    Columns of ``pages`` with the new names are replaced.
    """
    index = defaultdict(list)
    for r in rules.collect():
        index[r["least"]].append((-r["confidence"], " + ".join(r["tokens"]), frozenset(r["tokens"])))
    shared = pages.sparkSession.sparkContext.broadcast(dict(index))

    def match(batch: pa.RecordBatch) -> list[pa.Array]:
        index, names, values = shared.value, [], []
        for found in batch.column("_url_tokens").to_pylist():
            held = set(found)
            best = min((rule for t in found for rule in index.get(t, ()) if rule[2] <= held), default=None, key=lambda r: r[:2])
            names.append(best and best[1])
            values.append(best and -best[0])
        return [pa.array(names, pa.string()), pa.array(values, pa.float64())]

    return appended(pages.withColumn("_url_tokens", tokens(F.col(url_col))), match, {"mined_rule": "string", "mined_confidence": "double"}).drop("_url_tokens")


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], mined: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``mined_rule`` and ``mined_confidence``.

    The verdict is that of the longest rule that fits; without one it is ``block`` if a mined rule matches, else
    ``allow``. A null URL, or one without ``://``, has an empty host and path. Rows are judged one by one, so repeated
    rows, ties and very long URLs need no care; an empty table stays empty. Columns with the new names are replaced.
    """
    found = matched(pages.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))}), mined, url_col)
    by_rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumns({"rule": by_rule["rule"], "verdict": F.coalesce(by_rule["verdict"], own)})
