"""Registered queries: corpus profiling, sampling and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as TX
from ..operators import pairing, profile, quantiles, rules, sampling, tables
from ..session import checkpoint_root, shared_path
from ..sources import io, versions
from . import lexicons as LX
from .common import load, r6


def _clean_docs(spark, sf_dir, *extra):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", *extra)
    return docs.select("doc_id", TX.clean_text("text").alias("c"), *extra)


DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


def csv_documents_q(spark, sf_dir):
    """The documents written as quoted CSV and read back: line breaks, quotes
    and commas stay, blank fields are null, an unknown language is empty."""
    folder = shared_path(spark, "csv-documents")
    load(spark, sf_dir, "documents").write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    back = io.fill_blank(io.read_csv(spark, folder, DOCUMENTS), ["lang"])
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("length"),
                       "lang", "source", "n_chars")


def raw_message_pairs_q(spark, sf_dir):
    """Conversations as a raw message export, where ids are text and a reply
    names its message by a padded id and a message names ``nan``; read back, ids
    cleaned, and paired."""
    conv = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    key = F.concat("conv_id", F.lpad(F.col("turn").cast("string"), 6, "0"))
    before = F.concat("conv_id", F.lpad((F.col("turn") - 1).cast("string"), 6, "0"), F.lit("  "))
    user = F.col("role") == "user"
    folder = shared_path(spark, "raw-messages")
    conv.select(F.concat(F.lit(" "), key).alias("tweet_id"), F.col("role").alias("author_id"), user.alias("inbound"),
                F.lit(None).cast("string").alias("created_at"), "text", F.lit("").alias("response_tweet_id"),
                F.when(user, F.lit("nan")).otherwise(before).alias("in_response_to_tweet_id")
                ).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    raw = io.read_csv(spark, folder, io.RAW_MESSAGES)
    pairs = pairing.reply_pairs(
        raw, is_message=F.col("inbound"), is_reply=~F.col("inbound"), message_key=[TX.normalize_id("tweet_id")],
        reply_to_key=[TX.normalize_id("in_response_to_tweet_id")], message_cols={"customer_msg": F.col("text")},
        reply_cols={"brand_reply": F.col("text")}, key_names=["message_id"])
    return pairs.select("message_id", F.md5("customer_msg").alias("customer_md5"), F.md5("brand_reply").alias("reply_md5"))


def messy_scores_q(spark, sf_dir):
    """Labels as a hand-edited score sheet (padded headers and fields, a last
    empty column, unusable numbers), read back without the unusable rows."""
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    score = F.when(F.col("toxic") == 1, F.lit("n/a")).otherwise(F.concat(F.col("quality").cast("string"), F.lit(".5")))
    folder = shared_path(spark, "messy-scores")
    labels.select(F.col("doc_id").alias("doc_id "), F.concat(F.lit(" "), score, F.lit(" ")).alias(" score "),
                  F.concat(F.lit(" "), F.col("toxic").cast("string")).alias("toxic"), F.lit(None).cast("string").alias(" ")
                  ).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    read = io.read_messy_scores(spark, folder, ["score"])
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), "score", F.col("toxic").cast("int").alias("toxic"))


def text_profile_q(spark, sf_dir):
    checkpoint_root(spark)
    docs = load(spark, sf_dir, "documents", "text", "lang").select("lang", TX.clean_text("text").alias("c"))
    # three small columns; the texts are cleaned once
    d = docs.select("lang", F.length("c").alias("len"), TX.is_blank("c").alias("blank"),
                    TX.looks_non_english("c").alias("other")).checkpoint(eager=True)
    prof = profile.numeric_profile(d, "len", ["lang"], extra={
        "n_docs": F.count(F.lit(1)), "n_blank": F.count_if("blank"), "n_non_english": F.count_if("other")})
    return prof.select("lang", "n_docs", "n_blank", "n_non_english",
                    *[r6(F.col(c)).alias(f"{c}_len") for c in
                      ("mean", "std", "min", "q25", "q50", "q75", "max")])


def price_quantiles_q(spark, sf_dir):
    """Exact quantiles of the line prices by return flag and line status."""
    li = load(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice")
    q = quantiles.exact_quantiles(li, "l_extendedprice", [0.01, 0.25, 0.5, 0.9, 0.999], ["l_returnflag", "l_linestatus"])
    return q.select("l_returnflag", "l_linestatus", *[
        r6(F.col("quantiles")[k]).alias(name) for k, name in enumerate(("q01", "q25", "q50", "q90", "q999"))])


def top_ngrams_q(spark, sf_dir):
    d = _clean_docs(spark, sf_dir)
    return profile.top_ngrams(d, TX.eda_tokens("c"), 60, (1, 2, 3))


def length_histogram_q(spark, sf_dir):
    d = _clean_docs(spark, sf_dir)
    h = profile.histogram(d, F.length("c"), bins=30)
    return h.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "count")


def value_counts_q(spark, sf_dir):
    ev = load(spark, sf_dir, "events", "event_type")
    return profile.value_counts(ev, "event_type", dropna=False)


def counts_having_q(spark, sf_dir):
    ev = load(spark, sf_dir, "events", "user_id")
    return profile.counts_having(ev, "user_id", 70)


def top_unigrams_q(spark, sf_dir):
    d = _clean_docs(spark, sf_dir)
    return profile.top_terms(d, TX.eda_tokens("c"), 50)


def top_bigrams_q(spark, sf_dir):
    toks = _clean_docs(spark, sf_dir).select(TX.eda_tokens("c").alias("toks"))
    return profile.top_bigrams(toks, "toks", 30)


def length_stratified_sample_q(spark, sf_dir):
    d = _clean_docs(spark, sf_dir)
    s = sampling.length_stratified_sample(d, "c", "doc_id", n=500, seed=42)
    return s.select("id", "doc_id", "length", "band")


def _dedup_pool(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return tables.dedupe_keep_first(docs, ["text"], ["doc_id"])


def quota_sample_q(spark, sf_dir):
    s = sampling.quota_sample(_dedup_pool(spark, sf_dir), "lang", "doc_id", LX.LANG_QUOTAS, seed=42)
    return s.select("doc_id", "lang")


def review_workbook_q(spark, sf_dir):
    """Build a review workbook: de-duplicated pool -> per-language quota sample
    -> ids in shuffle order -> fixed review columns (empty labels)."""
    picked = sampling.quota_sample(_dedup_pool(spark, sf_dir), "lang", "doc_id", LX.LANG_QUOTAS, seed=42)
    hint = F.lit(None).cast("string")
    for lang_, guess in LX.LANG_HINTS.items():
        hint = F.when(F.col("lang") == lang_, F.lit(guess)).otherwise(hint)
    shaped = picked.select("doc_id", TX.clean_text("text").alias("c"),
                           F.coalesce(hint, F.lit("other")).alias("guess"),
                           TX.hash_order("doc_id", "42w").alias("_h"))
    ided = tables.sequential_ids(shaped, ["_h", "doc_id"], "id", bounded=True)  # <= sum of quotas
    return tables.review_workbook(ided, "id", "c", None, "guess")


def quota_gap_q(spark, sf_dir):
    return sampling.quota_gap(_dedup_pool(spark, sf_dir), "lang", LX.LANG_TARGETS)


def proportional_sample_q(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "lang")
    return sampling.proportional_sample(docs, "lang", "doc_id", total=30, floor=2, seed=99).select(
        "doc_id", "lang")


def edge_case_tags(c: str = "c"):
    """The six tagged predicates of the edge-case miner, in priority order."""
    n = F.length(F.col(c))
    preds = {
        "multi_intent": (TX.contains_words(c, P.EDGE_MULTI_JOINERS)
                         & TX.contains_words(c, P.EDGE_MULTI_TOPICS) & (n > 80)),
        "anger_sarcasm": (TX.contains_words(c, P.EDGE_ANGER_WORDS)
                          | F.coalesce(F.col(c).rlike(P.EDGE_ANGER_PUNCT), F.lit(False))),
        "short_fragment": n.between(2, 10),
        "very_long": n > 240,
        "image_reference": TX.contains_words(c, P.EDGE_IMAGE_WORDS),
        "non_english": TX.looks_non_english(c),
    }
    return [(tag, F.coalesce(preds[tag], F.lit(False)), cnt, seed) for tag, cnt, seed in P.EDGE_TAGS]


def edge_cases_q(spark, sf_dir):
    d = _clean_docs(spark, sf_dir)
    return sampling.tagged_sample(d, "doc_id", "c", edge_case_tags("c")).select("doc_id", "tag")


def weak_labels_q(spark, sf_dir):
    d = _clean_docs(spark, sf_dir)
    tags = [(label, rules.regex_filter("c", pat, min_len=P.MIN_MINED_LENGTH), P.RARE_INTENT_CAP, 42)
            for label, pat in LX.WEAK_LABELS]
    return sampling.tagged_sample(d, "doc_id", "c", tags).select(
        "doc_id", F.col("tag").alias("keyword_label"))


def topup_mining_q(spark, sf_dir):
    """Top-up candidates per target intent from the documents whose text no
    labelled document has."""
    d = _clean_docs(spark, sf_dir)
    used = tables.keep_keys(d, load(spark, sf_dir, "labels", "doc_id"), "doc_id")
    return sampling.topup_candidates(d, "doc_id", "c", used, "c", LX.TOPUP_LABELS).select(
        "doc_id", F.col("tag").alias("intent_llm_guess"))


def review_order_q(spark, sf_dir):
    """Review order: toxic documents last, then language (unknown last), id."""
    docs = load(spark, sf_dir, "documents", "doc_id", "lang")
    labels = load(spark, sf_dir, "labels", "doc_id", "toxic")
    d = docs.join(labels, "doc_id", "left").withColumn("edge", F.coalesce("toxic", F.lit(0)))
    return tables.sorted_positions(d, ["edge", "lang", "doc_id"]).select("doc_id", "position")


def dedupe_keep_first_q(spark, sf_dir):
    return _dedup_pool(spark, sf_dir).select("doc_id", "lang")


def merge_topup_q(spark, sf_dir):
    """Main table (documents) + top-up rows (user turns of conversations),
    aligned to the main schema, deduplicated by text (main first), renumbered."""
    main = load(spark, sf_dir, "documents", "doc_id", "text", "lang").select(
        F.lit("main").alias("origin"), F.lit(0).alias("prio"), F.col("doc_id").alias("src_id"),
        F.lit(0).cast("long").alias("src_turn"), "text", "lang")
    conv = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    topup = conv.where(F.col("role") == "user").select(
        F.lit("topup").alias("origin"), F.lit(1).alias("prio"), F.col("conv_id").alias("src_id"),
        F.col("turn").alias("src_turn"), "text")
    merged = tables.union_aligned(main, topup, fill="")
    kept = tables.dedupe_keep_first(merged, ["text"], ["prio", "src_id", "src_turn"])
    ided = tables.sequential_ids(kept, ["prio", "src_id", "src_turn"], "id")
    return ided.select("id", "origin", "src_id", "src_turn", "lang")


def exclude_used_q(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    labels = load(spark, sf_dir, "labels", "doc_id")
    used = tables.keep_keys(docs, labels, "doc_id")
    return tables.exclude_texts(docs, "text", used, "text").select("doc_id")


def resume_remaining_q(spark, sf_dir):
    """Prior predictions = labels.quality; remaining documents are scored by a
    length rule and appended; finished rows are kept as they are."""
    docs = load(spark, sf_dir, "documents", "doc_id", "n_chars")
    prev = load(spark, sf_dir, "labels", "doc_id", "quality").select(
        "doc_id", F.col("quality").cast("string").alias("prediction"))
    done, remaining = tables.resume(docs, prev, "doc_id", "prediction")
    new = remaining.select("doc_id", F.when(F.col("n_chars") >= 300, "1").otherwise("0").alias("prediction"),
                           F.lit("new").alias("status"))
    return done.select("doc_id", "prediction", F.lit("kept").alias("status")).unionByName(new)


def _fixes(spark, sf_dir):
    """(labels, corrections of their quality)."""
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = load(spark, sf_dir, "documents", "doc_id", "n_chars")
    c1 = labels.where(F.col("toxic") == 1).select(F.lit(1).alias("seq"), "doc_id",
                                                  F.lit(0).alias("quality"))
    c2 = (labels.where(F.col("toxic") == 1).join(docs, "doc_id").where(F.col("n_chars") < 1000)
          .select(F.lit(2).alias("seq"), "doc_id", F.lit(1).alias("quality")))
    c3 = (tables.exclude_keys(docs, labels.select("doc_id"), "doc_id").where(F.col("n_chars") > 15000)
          .select(F.lit(3).alias("seq"), "doc_id", F.lit(0).alias("quality")))
    return labels, c1.unionByName(c2).unionByName(c3)


def _corrected(spark, sf_dir):
    """(corrected labels, ids that corrections name and the labels lack)."""
    labels, fixes = _fixes(spark, sf_dir)
    return tables.apply_corrections(labels, fixes, "doc_id", "seq", ["quality"])


def correct_files_q(spark, sf_dir):
    """The same corrections on a table of many files, of which only those with a
    named id are rewritten; the version before them is read again beside it."""
    labels, fixes = _fixes(spark, sf_dir)
    base = shared_path(spark, "versioned-labels")
    first = versions.create(labels.repartitionByRange(16, "doc_id"), base)
    second, _, _ = versions.correct(spark, base, first, labels.schema, fixes, "doc_id", "seq", ["quality"])
    before = versions.read(spark, base, first, labels.schema).withColumnRenamed("quality", "quality_before").drop("toxic")
    return versions.read(spark, base, second, labels.schema).join(before, "doc_id").select(
        "doc_id", "quality", "toxic", "quality_before")


def unknown_corrections_q(spark, sf_dir):
    return _corrected(spark, sf_dir)[1]


def apply_corrections_q(spark, sf_dir):
    out, _ = _corrected(spark, sf_dir)
    return out.select("doc_id", F.col("quality").cast("int").alias("quality"), "toxic", "corrected")
