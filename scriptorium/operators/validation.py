"""References against canonical records: field checks, status, breakers and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions.fuzzy import similarity

TITLE_MIN, AUTHOR_MIN, JOURNAL_MIN = 90, 85, 55
#: Worst first, as reports list them; the others come after.
STATUS_RANK = {"dead_doi": 0, "mismatch": 1, "doi_suggested": 2, "unverifiable": 3}
FIELDS = ("title", "authors", "year", "container", "volume", "issue", "pages")


def _present(x: Column) -> Column:
    return F.coalesce(F.length(x) > 0, F.lit(False))


def _check(name: str, ours: Column, theirs: Column, ok: Column) -> Column:
    """Null unless both sides are there."""
    return F.when(_present(ours) & _present(theirs), F.struct(F.lit(name).alias("field"), ours.alias("ours"), theirs.alias("canonical"), F.coalesce(ok, F.lit(False)).alias("ok")))


def field_checks(pairs: DataFrame) -> DataFrame:
    """pairs: title, author (a surname), year, container, volume, issue, pages, and the same with
    ``c_`` for the canonical record (and c_short for the short container title). Adds ``checks``."""
    c = lambda x: F.col(f"c_{x}")
    pairs = pairs.withColumn("_t", similarity("token_sort", F.col("title"), c("title"), True)).withColumn("_a", similarity("ratio", F.col("author"), c("author"), True))
    short = c("short") if "c_short" in pairs.columns else F.lit(None).cast("string")
    pairs = pairs.withColumn("_j", F.greatest(F.coalesce(similarity("token_set", F.col("container"), c("container"), True), F.lit(0.0)), F.coalesce(similarity("token_set", F.col("container"), short, True), F.lit(0.0))))
    a, b = T.norm_pages(F.col("pages")), T.norm_pages(c("pages"))
    first = lambda x: F.get(F.split(x, "-"), F.lit(0))
    checks = [
        _check("title", F.col("title"), c("title"), F.col("_t") >= TITLE_MIN),
        _check("authors", F.col("author"), c("author"), F.col("_a") >= AUTHOR_MIN),
        _check("year", F.col("year"), c("year"), F.trim("year") == F.trim(c("year"))),
        _check("journal", F.col("container"), F.coalesce(T.clean(c("container")), short), F.col("_j") >= JOURNAL_MIN),
        _check("volume", F.col("volume"), c("volume"), F.trim("volume") == F.trim(c("volume"))),
        _check("issue", F.col("issue"), c("issue"), F.trim("issue") == F.trim(c("issue"))),
        _check("pages", F.col("pages"), c("pages"), (a == b) | (first(a) == first(b))),
    ]
    return pairs.withColumn("checks", F.filter(F.array(*checks), lambda x: x.isNotNull())).drop("_t", "_a", "_j")


def validate(entries: DataFrame, canonical: DataFrame) -> DataFrame:
    """entries: pos, doi and fields; canonical: doi and fields. With a DOI: dead_doi, verified or
    mismatch (verified also when nothing could be compared); without: unverifiable. Adds status,
    checks and n_bad."""
    theirs = canonical.select(F.lower("doi").alias("_doi"), *(F.col(x).alias(f"c_{x}") for x in canonical.columns if x != "doi"))
    own = entries.withColumn("_own", F.nullif(F.lower(T.normalize_doi(F.col("doi"))), F.lit("")))
    pairs = field_checks(own.join(theirs, own["_own"] == theirs["_doi"], "left"))
    bad = F.size(F.filter("checks", lambda x: ~x["ok"]))
    status = F.when(F.col("_own").isNull(), "unverifiable").when(F.col("_doi").isNull(), "dead_doi").when(bad == 0, "verified").otherwise("mismatch")
    return pairs.withColumn("status", status).withColumn("n_bad", F.when(F.col("_doi").isNotNull(), bad).otherwise(0)).drop("_own", "_doi")


def suggest_doi(record: DataFrame, best: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Unverifiable records (pos, status) with a best match (pos, doi, score) at the threshold that has
    a DOI become doi_suggested."""
    found = best.where((F.col("score") >= threshold) & (F.length("doi") > 0)).select("pos", F.col("doi").alias("suggested_doi"))
    out = record.join(found, "pos", "left")
    return out.withColumn("status", F.when((F.col("status") == "unverifiable") & F.col("suggested_doi").isNotNull(), "doi_suggested").otherwise(F.col("status")))


def by_status(records: DataFrame) -> DataFrame:
    flagged = F.col("status").isin(*STATUS_RANK)
    return records.groupBy("status").agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"))


def status_rank(status: Column) -> Column:
    return F.coalesce(T.lookup(status, {k: str(v) for k, v in STATUS_RANK.items()}).cast("int"), F.lit(len(STATUS_RANK)))


def breaker(events: DataFrame, by: str, order: list[str], failed: Column, after: int = 2) -> DataFrame:
    """After ``after`` failures in a row (a success resets the count), all later rows are skipped. Adds
    ``streak`` (failures in a row up to the row) and ``skipped``."""
    own = Window.partitionBy(by).orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    run = events.withColumn("_run", F.sum(F.when(failed, 0).otherwise(1)).over(upto))
    run = run.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    open_ = F.max(F.when(F.col("streak") >= after, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return run.withColumn("skipped", F.coalesce(open_, F.lit(0)) == 1).drop("_run")


def apply_corrections(entries: DataFrame, records: DataFrame, decisions: DataFrame) -> DataFrame:
    """entries: key and fields; records: key, bad (array of failing fields), suggested_doi and c_
    fields; decisions: key, no, action (approve, deny, edit; the last one counts) and e_ fields.
    approve takes the canonical value of failing fields and a suggested DOI; edit takes the edited
    fields (empty: null); the key always stays."""
    last = decisions.groupBy("key").agg(F.max_by(F.struct(*[c for c in decisions.columns if c != "key"]), "no").alias("d"))
    out = entries.join(last, "key", "left").join(records, "key", "left")
    fields = [c for c in entries.columns if f"e_{c}" in decisions.columns]

    def value(c: str) -> Column:
        edited, own = T.clean(F.col(f"d.e_{c}")), F.col(c)
        if c == "doi":
            approved = F.coalesce(F.col("suggested_doi"), own)
        else:
            approved = F.when(F.array_contains("bad", "journal" if c == "container" else c), F.col(f"c_{c}")).otherwise(own)
        return F.when(F.col("d.action") == "edit", edited).when((F.col("d.action") == "approve") & F.col("bad").isNotNull(), approved).otherwise(own).alias(c)

    return out.select(*(value(c) if c in fields else F.col(c) for c in entries.columns))


def author_summary(authors: Column) -> Column:
    return N.compact(authors)
