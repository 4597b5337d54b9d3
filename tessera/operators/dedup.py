"""Three-layer deduplication of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import companies_compatible, company_key, company_tokens, jaccard, title_key, tokens
from ..session import cut_lineage
from .graph import components
from .retrieval import term_counts, vocabulary, weigh


def deduplicate(jobs: DataFrame, id_col: str = "job_id", title_similarity: float = 0.80, company_similarity: float = 0.92, title_overlap: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(jobs without duplicates, a report of those left out and why).

    Links: equal company and title keys ("exact"); equal titles, compatible
    companies and similar descriptions ("company_name_variant"); equal
    companies, nearly equal descriptions, similar titles, same city and same
    experience ("same_description"). Of each component the posting with the latest
    deadline stays, then the longest description, then the smallest id. Exact
    groups are linked to their smallest id, and only that one is compared
    further, so a group's pairs are never listed.
    """
    frame = jobs.withColumns({
        "_id": F.col(id_col), "_ck": company_key(F.col("company_name")), "_ct": company_tokens(F.col("company_name")), "_tk": title_key(F.col("title")),
        "_text": F.coalesce("description_clean", F.lit("")), "_length": F.length(F.coalesce("description_clean", F.lit(""))), "_city": F.col("city"), "_exp": F.col("experience_min"),
    })
    group = W.partitionBy("_ck", "_tk")
    exact = frame.select("_id", F.min("_id").over(group).alias("_first")).where("_id <> _first").select(F.col("_first").alias("a"), F.col("_id").alias("b"), F.lit(1).alias("layer"))
    # rows of an exact group whose text, city or experience differ may link to others by themselves
    distinct = cut_lineage(frame.groupBy("_ck", "_ct", "_tk", F.sha2("_text", 256).alias("_digest"), "_city", "_exp").agg(F.min("_id").alias("_id")).drop("_digest"))
    by_title = _same_titles(distinct).withColumns({"layer": F.lit(2), "least": F.lit(title_similarity)})
    by_company = _similar_titles(distinct, title_overlap).withColumns({"layer": F.lit(3), "least": F.lit(company_similarity)})
    pairs = cut_lineage(by_title.unionByName(by_company))
    texts = frame.select("_id", "_text").join(distinct.select("_id").distinct(), "_id", "left_semi")
    # frequencies count all texts; only those in a pair are weighed
    terms = texts.select(F.explode(F.array_distinct(tokens(F.col("_text")))).alias("term"), F.lit(1).alias("tf"))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    counts = cut_lineage(term_counts(texts.join(paired, "_id", "left_semi"), "_id", "_text", bigrams=False))
    known = vocabulary(terms.join(counts.select("term").distinct(), "term", "left_semi"), distinct.agg(F.count("*").alias("n")))
    weights = cut_lineage(weigh(counts, cut_lineage(known), sublinear=True))
    wa, wb = weights.toDF("a", "term", "wa"), weights.toDF("b", "term", "wb")
    cosine = pairs.join(wa, "a").join(wb, ["b", "term"]).groupBy("a", "b", "layer", "least").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    links = exact.unionByName(cosine.where("cosine >= least").select("a", "b", "layer"))
    reason = links.select(F.col("a").alias("_id"), "layer").unionByName(links.select(F.col("b").alias("_id"), "layer")).groupBy("_id").agg(F.min("layer").alias("_layer"))
    roots = components(links.select("a", "b")).select(F.col("id").alias("_id"), "root")
    whole = frame.join(roots, "_id", "left").withColumn("_root", F.coalesce("root", "_id"))
    order = W.partitionBy("_root").orderBy(F.coalesce(F.col("deadline").cast("string"), F.lit("")).desc(), F.col("_length").desc(), "_id")
    ranked = whole.withColumns({"_rank": F.row_number().over(order), "_kept": F.first("_id").over(order), "_kept_company": F.first("company_name").over(order)})
    kept = ranked.where("_rank = 1").select(jobs.columns)
    why = F.element_at(F.array(*map(F.lit, ("exact", "company_name_variant", "same_description"))), F.col("_layer"))
    report = ranked.where("_rank > 1").join(reason, "_id", "left").select(F.col("_id").alias("job_id"), "company_name", "title", F.col("_kept").alias("kept_job_id"), F.col("_kept_company").alias("kept_company"), F.coalesce(why, F.lit("duplicate")).alias("reason"))
    return kept, report


def _rare_first(frame: DataFrame, keys: list[str], items: str) -> DataFrame:
    """keys and ``_sorted``, the distinct values of the array ``items`` with those of the fewest rows first."""
    listed = frame.select(*keys, F.explode(F.array_distinct(items)).alias("_item"))
    common = listed.groupBy("_item").agg(F.count("*").alias("_n"))
    ordered = listed.join(common, "_item").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_item"))).alias("_sorted"))
    return ordered.withColumn("_sorted", F.col("_sorted._item"))


def _rows(pairs: DataFrame, distinct: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(a, b) of the rows that have a pair's keys and its two values of the columns ``left`` and ``right``."""
    own = left.removesuffix("_l")
    for side, name in ((left, "_one"), (right, "_two")):
        rows = distinct.select(*(F.col(k).alias(f"r{k}") for k in keys), F.col(own).alias("r_own"), F.col("_id").alias(name))
        same = F.col(side) == F.col("r_own")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"r{k}"))
        pairs = pairs.join(rows, same).drop("r_own", *(f"r{k}" for k in keys))
    return pairs.where("_one <> _two").select(F.least("_one", "_two").alias("a"), F.greatest("_one", "_two").alias("b")).distinct()


def _same_titles(distinct: DataFrame) -> DataFrame:
    """(a, b) of equal titles and different, compatible companies.

    Companies are compared once for each title: the one that lies within the
    other shows its rarest word there.
    """
    known = distinct.where("length(_tk) >= 3").select("_tk", "_ck", "_ct").distinct()
    rarest = _rare_first(distinct.select("_ck", "_ct").distinct(), ["_ck"], "_ct").select("_ck", F.col("_sorted")[0].alias("_word"))
    inner = known.join(rarest, "_ck").select("_tk", "_word", F.col("_ck").alias("_ck_l"), F.col("_ct").alias("_ct_l"))
    outer = known.select("_tk", F.explode("_ct").alias("_word"), F.col("_ck").alias("_ck_r"), F.col("_ct").alias("_ct_r"))
    pairs = inner.join(outer, ["_tk", "_word"]).where("_ck_l <> _ck_r").where(companies_compatible(F.col("_ct_l"), F.col("_ct_r")))
    return _rows(pairs.select("_tk", F.least("_ck_l", "_ck_r").alias("_ck_l"), F.greatest("_ck_l", "_ck_r").alias("_ck_r")).distinct(), distinct, ["_tk"], "_ck_l", "_ck_r")


def _similar_titles(distinct: DataFrame, overlap: float) -> DataFrame:
    """(a, b) of one company, city and experience whose different titles overlap so much.

    Different titles are compared, not their rows. Token sets that overlap so
    much share one of their first tokens in any fixed order; rare ones come first.
    """
    keys = ["_ck", "_city", "_exp"]
    known = distinct.where("_city is not null").select(*keys, "_tk").distinct()
    titles = known.select("_tk").distinct().withColumn("_tokens", F.split("_tk", " "))
    first = F.slice("_sorted", F.lit(1), (F.size("_sorted") - F.ceil(F.size("_sorted") * overlap - 1e-9) + 1).cast("int"))
    prefixed = known.join(_rare_first(titles, ["_tk"], "_tokens").select("_tk", F.explode(first).alias("_token")), "_tk")
    l, r = prefixed.alias("l"), prefixed.alias("r")
    near = l.join(r, F.expr("l._ck = r._ck and l._token = r._token and l._city = r._city and l._exp <=> r._exp and l._tk < r._tk"))
    near = near.where(jaccard(F.split("l._tk", " "), F.split("r._tk", " ")) >= overlap)
    pairs = near.select(*(F.col(f"l.{k}") for k in keys), F.col("l._tk").alias("_tk_l"), F.col("r._tk").alias("_tk_r")).distinct()
    return _rows(pairs, distinct, keys, "_tk_l", "_tk_r")
