"""URL filters: explicit rules, and association rules mined with FP-growth.

Explicit rules (host and path prefix; the longest that fits wins) decide first. For all other urls,
token combinations are mined from labelled urls: host labels, path parts with digits generalised and
query keys, all of each url. FP-growth runs on conditional bases, one for each token that enough bad urls
hold, with bad and good urls counted together, which gives each set's confidence as a rule
``tokens -> bad``. Rules under the support (a number of bad urls, the same at every size), the confidence
or the lift over the share of bad urls are pruned, as are those of which a part is a rule of at least
their confidence; sets that can only grow into such ones are not grown. So urls with many tokens that come
together are no burden; many tokens that good and bad urls mix freely have as many rules as there are.
Rules match through an inverted index: a rule is posted under its rarest token, urls look up their tokens,
and the few hits are checked for all tokens.

The rules are fitted on a bounded sample: up to about ``sample_rows`` labelled urls, chosen by a hash of
the url, so the number of rules is bounded too. Urls are told apart by a row number, so a host or a
token set with a third of all rows is no hot key.

Edge cases: a null url or one without ``://`` has an empty host and path, no tokens, and is allowed;
repeated rows stay; a null label is good; no labels, or none that are bad, give no mined rule; of rules of
equal confidence the one that sorts last is reported; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    some = lambda x: F.filter(x, lambda t: F.length(t) > 2)
    plain = lambda x: F.regexp_replace(F.lower(x), r"\d+", "#")
    parts = [
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), plain(x))),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), plain(x))),
        F.transform(F.split(query, "[&;]"), lambda x: F.concat(F.lit("q:"), F.lower(F.regexp_extract(x, "^[^=]*", 0)))),
    ]
    return F.coalesce(F.sort_array(F.array_distinct(some(F.concat(*parts)))), F.array().cast("array<string>"))


RULES = "rule_id string, tokens array<string>, anchor string, support bigint, confidence double"


def _grow(item: str, base: list[tuple[tuple[str, ...], int, int]], min_rows: int, least: float):
    """FP-growth from a token's conditional base: the tokens before it in each url's order (commonest first), bad and good
    urls. Yields (tokens, bad, good) of at least min_rows bad urls and the least confidence. A set that is in
    no good url isn't grown, nor is one by a token that all its urls hold: larger sets would hold a part of
    the same confidence or more, so no rule is lost, however many tokens a url has."""
    total = sum(b for _, b, _ in base), sum(g for _, _, g in base)
    if total[0] >= min_rows and total[0] / sum(total) >= least:
        yield (item,), *total
    todo = [((item,), total, base)] if total[0] >= min_rows and total[1] else []
    while todo:
        own, (bad, good), base = todo.pop()
        count: dict[str, list[int]] = {}
        for before, b, g in base:
            for t in before:
                c = count.setdefault(t, [0, 0])
                c[0] += b
                c[1] += g
        more = {t: (b, g) for t, (b, g) in count.items() if b >= min_rows and (b, g) != (bad, good)}
        yield from (((*own, t), b, g) for t, (b, g) in more.items() if b / (b + g) >= least)
        grown = {t for t, (_, g) in more.items() if g}
        parts: dict[str, dict[tuple[str, ...], list[int]]] = {t: {} for t in grown}
        for before, b, g in base:
            left = tuple(t for t in before if t in grown)
            for k, t in enumerate(left):
                c = parts[t].setdefault(left[:k], [0, 0])
                c[0] += b
                c[1] += g
        todo.extend(((*own, t), more[t], [(x, b, g) for x, (b, g) in part.items()]) for t, part in parts.items())


def mine(urls: DataFrame, min_confidence: float = 0.8, min_rows: int = 20, min_lift: float = 1.2) -> DataFrame:
    """urls (tokens, bad boolean) -> rules: rule_id, tokens, anchor (the rarest), support (bad urls), confidence."""
    spark = urls.sparkSession
    kinds = urls.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    kinds = written(kinds.withColumn("kind", F.monotonically_increasing_id()))
    total = kinds.agg(F.sum("bad"), F.sum("good")).first()
    if not total[0]:
        return spark.createDataFrame([], RULES)
    least = max(min_confidence, min(1.0, min_lift * total[0] / (total[0] + total[1])))
    each = kinds.select("kind", "bad", "good", F.explode("tokens").alias("t"))
    common = written(each.groupBy("t").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).where(F.col("b") >= min_rows))
    # of each url the tokens that enough bad ones hold, commonest first; those of no good url grow no larger rule
    held = each.join(common, "t").select("kind", "bad", "good", F.struct((-F.col("b") - F.col("g")).alias("n"), "t", (F.col("g") > 0).alias("grows")).alias("x"))
    held = held.groupBy("kind").agg(F.first("bad").alias("bad"), F.first("good").alias("good"), F.sort_array(F.collect_list("x")).alias("x"))
    held = held.groupBy("x").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).select("x", F.posexplode("x").alias("k", "own"), "bad", "good")
    before = F.when(F.col("own.grows"), F.transform(F.filter(F.slice("x", F.lit(1), F.col("k")), lambda x: x["grows"]), lambda x: x["t"])).otherwise(F.array().cast("array<string>"))
    base = held.select(F.col("own.t").alias("item"), before.alias("before"), "bad", "good").groupBy("item", "before").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    def run(batches):
        now, rows = None, []

        def found():
            sets = _grow(now, rows, min_rows, least)
            while some := list(islice(sets, 4096)):
                tokens = [sorted(t) for t, _, _ in some]
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(t) for t in tokens], pa.string()), pa.array(tokens, pa.list_(pa.string())), pa.array([now] * len(some), pa.string()), pa.array([b for _, b, _ in some], pa.int64()), pa.array([b / (b + g) for _, b, g in some], pa.float64())], names=["rule_id", "tokens", "anchor", "support", "confidence"])

        for batch in batches:
            for item, before, bad, good in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and item != now:
                    yield from found()
                    rows = []
                now = item
                rows.append((tuple(before), bad, good))
        if rows:
            yield from found()

    rules = written(base.repartition("item").sortWithinPartitions("item").mapInArrow(run, RULES))
    # rules that hold all tokens of another rule of at least their confidence say nothing new
    part = rules.select(F.col("tokens").alias("_part"), F.col("confidence").alias("_c"), F.col("anchor").alias("_t"))
    wide = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("_t"))
    weak = wide.join(part, "_t").where((F.size("_part") < F.size("tokens")) & (F.col("_c") >= F.col("confidence")) & (F.size(F.array_except("_part", "tokens")) == 0)).select("rule_id").distinct()
    return written(rules.join(weak, "rule_id", "left_anti"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (row, tokens) -> row, rule_id, confidence of the best rule of each url that any rule matches."""
    index = rules.select("rule_id", F.col("tokens").alias("_all"), F.col("anchor").alias("_t"), "confidence")
    hits = urls.select("row", "tokens", F.explode("tokens").alias("_t")).join(index, "_t").where(F.size(F.array_except("_all", "tokens")) == 0)
    return hits.groupBy("row").agg(F.max(F.struct("confidence", "rule_id")).alias("best")).select("row", "best.rule_id", "best.confidence")


def explicit(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest explicit rule that fits; rules: ("allow" or "block", "host/path")."""

    def fits(rule: str) -> Column:
        own, _, rest = rule.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)

    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    name = reduce(lambda c, r: c.when(fits(r[1]), r[1]), order[1:], F.when(fits(order[0][1]), order[0][1]))
    act = reduce(lambda c, r: c.when(fits(r[1]), r[0]), order[1:], F.when(fits(order[0][1]), order[0][0]))
    return name, act


def verdicts(urls: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """The urls that an explicit rule decides: url, bad. They can teach what is to be blocked."""
    own = urls.select(F.col(url_col).alias("url")).select("url", explicit(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("act"))
    return own.where("act is not null").select("url", (F.col("act") == "block").alias("bad"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], min_confidence: float = 0.8, min_rows: int = 20, min_lift: float = 1.2, sample_rows: int = 1_000_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (explicit, else null), verdict, mined (the association rule that
    blocks, else null). labelled: url, bad (boolean)."""
    rows = max(1, labelled.count())
    some = labelled.where(F.pmod(F.xxhash64("url", F.lit(6)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample_rows / rows)))
    mined = mine(some.select(tokens_of(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")), min_confidence, min_rows, min_lift)
    url = F.col(url_col)
    name, act = explicit(F.col("host"), F.col("path"), rules)
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    own = written(own.withColumn("rule", name).withColumn("_act", act).withColumn("row", F.monotonically_increasing_id()))
    hits = match(own.where("rule is null"), mined).select(F.col("row").alias("_row"), F.col("rule_id").alias("_mined"))
    out = own.join(hits, own["row"] == hits["_row"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_act", F.when(F.col("_mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"), F.col("_mined").alias("mined"))
