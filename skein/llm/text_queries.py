"""Queries of the text problems (8, 9 and 10) and their SQL."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import leaks, mixing, pieces
from skein.session import materialize, read_table

_GRAMS = """with w as (select doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null),
g as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from w where len(w) >= 12),
t as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items),
tg as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from t where len(w) >= 12),
hit as (select distinct doc_id, item_id from g join tg using (g))
"""


def p8_found(spark, d):
    """Documents that hold 12 or more consecutive words of an item."""
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_passages(spark, d):
    """Every longest verbatim match with its place in the document."""
    found = leaks.leaked_passages(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("item_word", "start_char", "end_char", "n_words")))


def p8_items(spark, d):
    """How many documents leak each item."""
    found = leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_kept(spark, d):
    """Documents left per source once the affected ones are removed."""
    kept = leaks.without_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return kept.groupBy("source").agg(F.count("*").alias("n_docs"))


def p9_mix(spark, d):
    """The mix at the target shares, as large as the caps allow: one row per token range of each slot."""
    return mixing.mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    """The shares the mix reached."""
    targets = read_table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mix_sources(read_table(spark, d, "documents"), targets), targets)


def p9_kept(spark, d):
    """What the mix promises, source by source: the target share and the most uses, unless what was reached breaks them.

    A share counts as reached within five deviations of a multinomial draw of the mix's slots, and a thousandth for short
    last blocks; a source whose documents hold no token takes no part, and the other shares are scaled up.
    """
    targets = read_table(spark, d, "mix_targets")
    mixed = materialize(mixing.mix_sources(read_table(spark, d, "documents"), targets))
    got = mixing.mix_report(mixed, targets).join(targets.select("source", "max_repeats"), "source")
    in_mix = F.when(F.col("n_tokens") > 0, F.col("target_share"))
    # eight rows, one per source, are left here
    got = got.select("*", F.sum("n_slots").over(W.partitionBy()).alias("slots"), (in_mix / F.sum(in_mix).over(W.partitionBy())).alias("goal"))
    near = F.abs(F.col("actual_share") - F.col("goal")) <= 5 * F.sqrt(F.col("goal") * (1 - F.col("goal")) / F.col("slots")) + 0.001
    return got.where("n_tokens > 0").select("source", F.when(near, F.col("goal")).otherwise(F.col("actual_share")).alias("share"), F.when(F.col("most_uses") <= F.col("max_repeats"), F.col("max_repeats")).otherwise(F.col("most_uses")).cast("long").alias("uses"))


def p9_blocks(spark, d):
    """The mix as packed blocks of token ids: how long they are, and a hash of each."""
    documents = read_table(spark, d, "documents")
    packed = mixing.packed_blocks(materialize(mixing.mix_sources(documents, read_table(spark, d, "mix_targets"))), documents)
    return packed.select("shard", "slot", "source", "block", F.size("tokens").alias("n_tokens"), F.xxhash64("tokens").alias("hash"))


def p10_pieces(spark, d):
    """Every article in pieces of at most 512 tokens with an overlap of 64."""
    return pieces.split_documents(read_table(spark, d, "documents"))


def p10_whole(spark, d):
    """Every text put together again from its pieces, each without what it shares with the one before, as its hash."""
    cut = pieces.split_documents(read_table(spark, d, "documents"))
    before = F.lag("end_char").over(W.partitionBy("doc_id").orderBy("piece_no"))
    own = cut.withColumn("skip", F.coalesce(before - F.col("start_char"), F.lit(0)).cast("int")).where("skip >= 0 and n_tokens <= 512")
    own = own.select("doc_id", "piece_no", F.expr("substring(text, skip + 1)").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", "text")))  # the pieces of one text: no more than the text itself
    return own.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).select("doc_id", F.md5("text").alias("hash"), F.length("text").cast("long").alias("n_chars"))


def p10_cuts(spark, d):
    """How pieces end, with their number and sizes."""
    cut = materialize(pieces.split_documents(read_table(spark, d, "documents"), with_text=False))
    return cut.groupBy("cut").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most_tokens"))


QUERIES = {f.__name__: f for f in (p8_found, p8_passages, p8_items, p8_kept, p9_mix, p9_shares, p9_kept, p9_blocks, p10_pieces, p10_whole, p10_cuts)}
_PASSAGES = """with s as (select doc_id, lower(text) t from documents where text is not null),
w as (select doc_id, regexp_extract_all(t, '[a-z0-9]+') w, regexp_extract_all(t, '[^a-z0-9]+') g, regexp_matches(t, '^[a-z0-9]') at_once from s),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g, unnest(range(1, len(w) - 10)) p from w where len(w) >= 12),
t as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items),
tg as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g, unnest(range(1, len(w) - 10)) q from t where len(w) >= 12),
hit as (select doc_id, item_id, p, q, p - row_number() over (partition by doc_id, item_id, p - q order by p) run from dg join tg using (g)),
isle as (select doc_id, item_id, min(p) p, min(q) q, max(p) + 11 last from hit group by doc_id, item_id, p - q, run),
long as (select doc_id, at_once, unnest(w) w, unnest(range(1, len(w) + 1)) i, unnest(case when at_once then list_prepend('', g) else g end[:len(w)]) g from w where doc_id in (select doc_id from isle)),
pos as (select doc_id, i, sum(length(g) + length(w)) over (partition by doc_id order by i) e, length(w) n from long)
"""

SQL = {
    "p8_passages": _PASSAGES + """select doc_id, item_id, q - 1 item_word, cast(a.e - a.n as bigint) start_char, cast(z.e as bigint) end_char, last - p + 1 n_words
from isle join pos a using (doc_id) join pos z using (doc_id) where a.i = p and z.i = last""",
    "p9_kept": """with t as (select source, target_share, max_repeats from mix_targets where target_share > 0 and max_repeats > 0 and source in (select source from documents where text <> ''))
select source, target_share / sum(target_share) over () as share, cast(max_repeats as bigint) uses from t""",
    "p10_whole": "select doc_id, md5(text) as hash, length(text) n_chars from documents where text <> ''",
    "p8_found": _GRAMS + "select doc_id, item_id from hit",
    "p8_items": _GRAMS + "select item_id, count(*) n_docs from hit group by 1",
    "p8_kept": _GRAMS + "select source, count(*) n_docs from documents where doc_id not in (select doc_id from hit) group by 1",
}
