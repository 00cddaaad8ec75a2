"""Benchmark decontamination by winnowing.

A text's fingerprints are the least 5-gram hash of every 6 neighbouring 5-grams. Six 5-grams span
ten words, so any run of ten words that a document and an item share leads both to keep the same
hash: no shared window can be missed. Items of fewer than ten words are one window; for each such
length that occurs, documents also give all their n-grams of that length. Joined fingerprints are
seeds, and every window around a seed is compared word by word, so hash collisions add nothing.

Plan: documents -> distinct fingerprints -> hash join with the items' (broadcast only while their
counted rows and bytes stay under bounds; beyond that a shuffle join, split where skewed) -> the candidate
documents are read again, their prints joined to the items' once more, with places, and extended.
A seed carries the words of its item that a window over it can reach, of the document as well.
Beyond the broadcast's bound, the seeds of a fingerprint with many items are dealt in DEAL parts, each
of which meets all of the documents' places. Only candidates' texts move. All expressions are built in.

Defined cases: null and empty texts have no words; items without words have no window; repeated
rows get the same result each; a null doc_id is a key like others, ids may be numbers or texts; rows of one id with
different texts are told apart by a 64-bit hash of the text; columns of any names may stand beside; empty tables
work; a very long text or item is looked at place by place, each with the words around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import asc_lower, bounded_broadcast, id_key, key_id, stored, table

WINDOW, GRAM, BROADCAST_ROWS, DEAL = 10, 5, 1_000_000, 16
SPAN = WINDOW - GRAM + 1


def words(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(asc_lower(t))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def _grams(w: str, k: int) -> Column:
    """Hashes of all k-grams of the words in column w, in order; k is part of the hash."""
    n = F.size(w)
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).otherwise(F.array().cast("array<bigint>"))


def _least(g: str) -> Column:
    """The least hash of every SPAN neighbours in g; the one of all if g is shorter but not empty."""
    n = F.size(g)
    at = lambda i: F.least(*[F.get(g, i + j) for j in range(SPAN)])
    return F.when(n >= SPAN, F.transform(F.sequence(F.lit(0), n - SPAN), at)).otherwise(F.array().cast("array<bigint>"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(id_key(docs, doc_id).alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("th"), docs[f"`{text}`"].alias("t"))


def hits(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """One row (id, th, item, s, e) for each hit window: words s to e (exclusive) of the document."""
    it = items.select(items[f"`{item_id}`"].alias("item"), words(items[f"`{item_text}`"]).alias("iw")).where(F.size("iw") > 0)
    short = sorted(r[0] for r in it.select(F.size("iw").alias("n")).where(F.col("n") < WINDOW).distinct().collect())  # nine values at most
    seeds = it.where(F.size("iw") >= WINDOW).select("item", "iw", F.lit(WINDOW).alias("len"), _grams("iw", GRAM).alias("g"))
    seeds = seeds.select("*", _least("g").alias("f"))

    def around(g: str, w: str, keep=None) -> Column:
        """Structs of each place p of g with its print, and the words (near, from lo on) that a window over it can reach."""
        lo = lambda p: F.greatest(F.lit(0), p - (WINDOW - GRAM))
        own = F.transform(g, lambda x, p: F.struct(x.alias("fp"), p.alias("p"), lo(p).alias("lo"), F.slice(w, lo(p) + 1, F.lit(2 * WINDOW)).alias("near")))
        return own if keep is None else F.filter(own, keep)

    # kept is what is the least of some SPAN neighbours that it belongs to; they begin at most SPAN - 1 places before it
    is_least = lambda s: F.exists(F.slice("f", F.greatest(F.lit(0), s.p - (SPAN - 1)) + 1, F.least(F.lit(SPAN), s.p + 1)), lambda x: x == s.fp)
    seeds = seeds.select("item", "len", F.size("iw").alias("n"), F.explode(around("g", "iw", is_least)).alias("s"))
    for k in short:
        own = it.where(F.size("iw") == k).select("item", "iw", F.lit(k).alias("len"), F.size("iw").alias("n"), _grams("iw", k).alias("g"))
        seeds = seeds.unionByName(own.select("item", "len", "n", F.explode(around("g", "iw")).alias("s")))
    seeds = stored(seeds.select("item", "len", F.col("s.fp").alias("fp"), "n", F.col("s.p").alias("q"), F.col("s.lo").alias("ilo"), F.col("s.near").alias("iw")), "seeds")
    prints = bounded_broadcast(seeds.select("fp").distinct(), BROADCAST_ROWS)

    def printed(df: DataFrame, keep: list[str]) -> DataFrame:
        df = df.select(*keep, words(F.col("t")).alias("w"))
        return df.select(*keep, "w", _grams("w", GRAM).alias("g"), *[_grams("w", k).alias(f"g{k}") for k in short])

    d = printed(_keyed(docs, doc_id, text), ["id", "th"])
    d = d.select("id", "th", F.explode(F.array_distinct(F.concat(_least("g"), *[F.col(f"g{k}") for k in short]))).alias("fp"))
    found = stored(d.join(prints, "fp", "left_semi").select("id", "th").distinct(), "candidates")

    c = printed(_keyed(docs, doc_id, text).join(bounded_broadcast(found.select("id", "th"), 100_000), ["id", "th"], "left_semi"), ["id", "th"])
    # of a document, for each print only the words that a window over it can reach go on, and of those the items' prints
    at = F.explode(F.concat(around("g", "w"), *[around(f"g{k}", "w") for k in short]))
    c = c.select("id", "th", at.alias("s")).select("id", "th", "s.fp", "s.p", "s.lo", "s.near").join(prints, "fp", "left_semi")
    near = bounded_broadcast(seeds, BROADCAST_ROWS // 10)
    if near is seeds:  # dealt: a fingerprint of many items and many documents is the work of DEAL tasks
        c = c.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
        hit = c.join(seeds.withColumn("part", F.pmod(F.xxhash64("item", "q"), F.lit(DEAL)).cast("int")), ["fp", "part"])
    else:
        hit = c.join(near, "fp")
    offs = F.sequence(F.lit(0), F.when(F.col("len") < WINDOW, 0).otherwise(WINDOW - GRAM))
    hit = hit.select("id", "th", "item", "len", "n", "iw", "ilo", "near", "lo", "p", "q", F.explode(offs).alias("o"))
    hit = hit.select("*", (F.col("p") - F.col("o")).alias("s"), (F.col("q") - F.col("o")).alias("is")).where("s >= 0 and `is` >= 0 and `is` + len <= n")
    hit = hit.where(F.slice("near", F.col("s") - F.col("lo") + 1, F.col("len")) == F.slice("iw", F.col("is") - F.col("ilo") + 1, F.col("len")))
    return hit.select("id", "th", "item", "s", (F.col("s") + F.col("len")).alias("e")).distinct()


def report(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = hits(docs, items, doc_id, text, item_id, item_text)
    fold = lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(a.e, x.s))).alias("n"), F.greatest(a.e, x.e).alias("e"))
    by = h.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"), F.collect_set(F.col("item").cast("string")).alias("items"))
    by = by.select("id", "th", F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), fold).n.cast("long").alias("n_hit"), "items")
    k = _keyed(docs, doc_id, text).select("id", "th", F.size(words(F.col("t"))).cast("long").alias("n_words"))
    k = k.join(bounded_broadcast(stored(by, "hits"), 100_000), ["id", "th"], "left")
    items_ = F.coalesce(F.sort_array("items"), F.array().cast("array<string>"))
    return k.select(
        key_id(F.col("id")).alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns."""
    bad = stored(hits(docs, items, doc_id, text, item_id, item_text).select("id", "th").distinct(), "contaminated")
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), id_key(docs, doc_id).alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("th"))
    return d.join(bounded_broadcast(bad, 500_000), ["id", "th"], "left_anti").select("row.*")


def op5_winnowing(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Hit windows of the table `src`, as DuckDB SQL.
HITS_SQL = f"""
iw as (select item_id, {WORDS_SQL} as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as x from (select *, unnest(range(0, greatest(1, len(w) - 9))) as i from iw where len(w) > 0)),
dw as (select doc_id, {WORDS_SQL} as w from src),
dwin as (select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as x from (select dw.*, n, unnest(range(0, len(w) - n + 1)) as i from dw, (select distinct n from win) where len(w) >= n)),
hit as (select doc_id, item_id, i, win.n from dwin join win using (n, x)),
nhit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n, string_agg(s, ',' order by s) as l from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)"""

SQL = f"""with src as (select * from documents), {HITS_SQL}
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(nhit.n, 0) as bigint) as n_hit, cast(coalesce(its.n, 0) as bigint) as n_items, sha256(coalesce(its.l, '')) as items_sha256, coalesce(nhit.n, 0) > 0 as contaminated
from dw left join nhit using (doc_id) left join its using (doc_id)"""
