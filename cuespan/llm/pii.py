"""Personal data: pattern spans, and terms that give a protected entity away.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers. Every word of a document that holds an
entity (kind and canonical value) is judged by how strongly it reveals it, over the whole corpus:
PMI(e; t) = log2(p(e|t) / p(e)) with the smoothed p(e|t) = (n(e,t) + SMOOTH p(e)) / (n(t) + SMOOTH), held against
the entity's information IC(e) = log2(N / n(e)). At REMOVE of IC or more the term is removed, at GENERALISE or more
it is generalised, wherever it stands in the entity's documents. All n count documents; smoothing lets few
documents prove less than many, and what fewer than EVIDENCE documents tell is generalised at most, as any rare word
stands beside something. As n(e,t) is n(e) at most, a term of too many documents for an entity can't
reach GENERALISE; such pairs are never made. Entities of the very same documents have the same counts with every
term, so they are judged as one (their documents are compared by two 64-bit hashes): a list of contacts costs its
terms, not its terms times its contacts.

A term is generalised to the longest of its beginnings (LADDER letters and a star) that no longer discloses: the
class of all words with that beginning takes the term's place, with its words' document counts added up and n(e)
for n(e,t). If no beginning is general enough the term becomes a bare mark.

Places are code points. A pattern's matches and the pieces between them give the places: match k
starts after pieces 0..k and matches 0..k-1, a running sum over the few rows of a document that has
matches. Patterns are possessive and start only where a match could first start, so that each text
is read in linear time and long runs use no stack.

Defined cases: null and empty texts have no spans; repeated rows get the same result each and count as
documents each; rows of one id with different texts are told apart by a 64-bit hash of the text; a null doc_id is a
key like others, ids may be numbers or texts; a very long text is read in linear time; equal spans of two kinds are
both reported; columns of any names may stand beside; empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, id_key, key_id, lookup, stored, table

REMOVE, GENERALISE = 0.95, 0.85
#: Documents that an entity and a term must share for the term to be removed.
EVIDENCE = 2
#: Lengths of the beginnings that a term may be generalised to.
LADDER = (6, 4, 3, 2, 1)
#: Documents without the entity that each term is taken to stand in besides the counted ones.
SMOOTH = 0.5

#: kind, pattern, a cheap test that any text with a match passes.
KINDS = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]+\.[0-9]"),
    ("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){11}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
]
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
WORD = r"\p{L}[\p{L}\p{N}]{2,}"
HIT = "struct<kind:int,k:int,val:string,gap:int>"
SPAN = "struct<s:bigint,kind:int,e:bigint,action:string,general:string>"


def _key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [id_key(docs, doc_id).alias("id"), F.xxhash64(docs[f"`{text}`"]).alias("th")]


def _valid(kind: Column, val: Column) -> Column:
    d = F.regexp_replace(val, "[^0-9]", "")
    n = F.length(d)
    digit = lambda i: F.substring(d, n - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    part = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    luhn = F.when(n.between(12, 19), F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, val.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")).when(kind == 2, luhn).otherwise(n.between(9, 15))


def base_spans(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row for each base span of each different (id, th): kind, s, e and val."""
    d = docs.select(*_key(docs, doc_id, text), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("t"))
    cols = []
    for i, (_, pattern, test) in enumerate(KINDS):
        cols += [F.when(F.col("t").rlike(test), F.regexp_extract_all("t", F.lit(pattern), 0)).alias(f"m{i}"), F.when(F.col("t").rlike(test), F.split("t", pattern, -1)).alias(f"p{i}")]
    d = d.select("id", "th", *cols).where(" or ".join(f"size(m{i}) > 0" for i in range(len(KINDS))))

    def rows(i: int) -> Column:
        at = lambda v, k: F.struct(F.lit(i).alias("kind"), k.alias("k"), v.alias("val"), F.length(F.get(f"p{i}", k)).alias("gap"))
        return F.coalesce(F.transform(f"m{i}", at), F.array().cast(f"array<{HIT}>"))

    h = d.select("id", "th", F.explode(F.concat(*[rows(i) for i in range(len(KINDS))])).alias("h")).select("id", "th", "h.*").dropDuplicates(["id", "th", "kind", "k"])
    w = Window.partitionBy("id", "th", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = F.sum(F.col("gap") + F.length("val")).over(w)
    h = h.select("*", e.alias("e")).select("*", (F.col("e") - F.length("val")).alias("s"))
    return h.where(_valid(F.col("kind"), F.col("val"))).select("id", "th", "kind", "s", "e", "val")


def _blanked(docs: DataFrame, base: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, t, c) of each different text with base spans: t has blanks in their place; c: its rows."""
    w = Window.partitionBy("id", "th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    b = base.select("id", "th", "s", "e", F.coalesce(F.max("e").over(w), F.lit(0)).alias("to")).where("e > to")
    cuts = b.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct(F.greatest("s", "to").cast("int").alias("s"), F.col("e").cast("int").alias("e"), F.col("to").cast("int").alias("to")))).alias("cuts"))
    d = docs.select(*_key(docs, doc_id, text), docs[f"`{text}`"].alias("t")).join(bounded_broadcast(cuts, 100_000), ["id", "th"])
    t = F.col("t")
    pieces = F.transform("cuts", lambda x: F.concat(F.substring(t, x.to + 1, x.s - x.to), F.repeat(F.lit(" "), x.e - x.s)))
    blank = F.concat(F.concat_ws("", pieces), F.substring(t, F.element_at("cuts", -1).e + 1, F.length(t)))
    return d.select("id", "th", blank.alias("t")).groupBy("id", "th").agg(F.first("t").alias("t"), F.count("*").alias("c"))


def term_spans(docs: DataFrame, base: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Rows (id, th, s, e, action, general) of all places of terms that disclose an entity of their document."""
    canon = F.when(F.col("kind") == 0, F.lower("val")).when(F.col("kind") == 1, F.col("val")).otherwise(F.regexp_replace("val", "[^0-9]", ""))
    words = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(WORD), 0), F.lower))
    held = stored(_blanked(docs, base, doc_id, text), "held")
    ents = base.select("id", "th", F.concat_ws(":", "kind", canon).alias("ent")).distinct().join(held.select("id", "th", "c"), ["id", "th"])
    ents = stored(ents, "ents")
    n_e = ents.groupBy("ent").agg(F.sum("c").alias("n_e"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id", "th")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "id", "th")).alias("b"))
    ents = lookup(ents, n_e, ["ent"], "rows").select("id", "th", "c", "n_e", F.concat_ws(":", "n_e", "a", "b").alias("ent")).distinct()
    ents = stored(ents, "ents_n")
    total = F.lit(float(max(docs.count(), 1)))
    most = ents.agg(F.max("n_e")).first()[0] or 0
    pmi = lambda n_et: F.log2((n_et + SMOOTH * F.col("n_e") / total) / (F.col("n_t") + SMOOTH) * total / F.col("n_e"))
    ic = F.log2(total / F.col("n_e"))
    discloses = lambda n_et: (ic > 0) & (pmi(n_et) >= GENERALISE * ic)
    own = held.select("id", "th", F.explode(words(F.col("t"))).alias("term"))
    n_w = own.groupBy("term").agg(F.count("*").alias("rows"))
    known = stored(docs.select(F.explode(words(docs[f"`{text}`"])).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    # no entity has a term of more documents than this: p(e|t) >= p(e) ** (1 - GENERALISE), and n(e,t) <= n(e)
    n_t = known.where(F.col("n_t") <= (most + 1) * F.pow(total, F.lit(1 - GENERALISE))).join(n_w, "term")
    own = lookup(own, n_t, ["term"], "rows").where("n_t is not null").groupBy("id", "th").agg(F.collect_list(F.struct("term", "n_t")).alias("terms"))
    pairs = ents.join(own, ["id", "th"]).select("id", "th", "c", "ent", "n_e", F.explode("terms").alias("x")).select("id", "th", "c", "ent", "n_e", "x.*").where(discloses(F.col("n_e")))
    pairs = stored(pairs, "pairs")
    n_et = F.sum("c")
    told = pairs.groupBy("ent", "term", "n_e", "n_t").agg(n_et.alias("n_et"), F.count("*").alias("rows")).where(discloses(F.col("n_et")))
    told = told.select("ent", "term", "n_e", "rows", F.when((pmi(F.col("n_et")) >= REMOVE * ic) & (F.col("n_et") >= EVIDENCE), "remove").otherwise("generalise").alias("action"))
    told = stored(told, "disclosing")
    told = told.join(_generalised(told, known, discloses), ["term", "n_e"], "left").select("ent", "term", "rows", "action", "general")
    of_text = lookup(pairs.select("id", "th", "ent", "term"), told, ["ent", "term"], "rows").where("action is not null")
    # of several entities the strictest decides: removal, else the shortest beginning, that of the fewest letters
    of_text = of_text.groupBy("id", "th", "term").agg(F.max("action").alias("action"), F.min(F.coalesce("general", F.lit(""))).alias("general"))
    of_text = stored(of_text, "told")
    texts = held.join(bounded_broadcast(of_text.select("id", "th").distinct(), 200_000), ["id", "th"], "left_semi")
    found = texts.select("id", "th", F.regexp_extract_all("t", F.lit(WORD), 0).alias("w"), F.split("t", WORD, -1).alias("g"))
    found = found.select("id", "th", F.explode(F.transform("w", lambda x, k: F.struct(k.alias("k"), F.lower(x).alias("term"), F.length(x).alias("n"), F.length(F.get("g", k)).alias("gap")))).alias("x")).select("id", "th", "x.*")
    e = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("id", "th").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    found = found.select("id", "th", "term", (e - F.col("n")).alias("s"), e.alias("e"))
    return found.join(of_text, ["id", "th", "term"]).select("id", "th", "s", "e", "action", "general")


def _generalised(told: DataFrame, known: DataFrame, discloses) -> DataFrame:
    """(term, n_e, general) of terms to generalise: their longest beginning that discloses no entity of n_e documents.

    The words' counts are added up by beginning, within map tasks first; only beginnings of told terms stay."""
    stems = lambda t: F.filter(F.array(*[F.when(F.length(t) > n, F.left(t, F.lit(n))) for n in LADDER]), lambda x: x.isNotNull())
    asked = told.where("action = 'generalise'").select("term", "n_e").distinct()
    asked = stored(asked.select("term", "n_e", F.explode(stems(F.col("term"))).alias("stem")), "asked")
    classes = known.select(F.explode(stems(F.col("term"))).alias("stem"), "n_t")
    # terms that share a beginning may be many: lookup deals the rows of such beginnings apart
    n_s = stored(asked.groupBy("stem").agg(F.count("*").alias("rows")), "beginnings")
    n_t = classes.join(bounded_broadcast(n_s, 200_000), "stem").groupBy("stem", "rows").agg(F.sum("n_t").alias("n_t"))
    fit = lookup(asked, n_t, ["stem"], "rows").where(~discloses(F.col("n_e")))
    return fit.groupBy("term", "n_e").agg(F.max_by("stem", F.length("stem")).alias("general"))


def all_spans(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row for each different (id, th) with spans: spans, sorted by start and kind, of (s, kind, e, action, general)."""
    base = stored(base_spans(docs, doc_id, text), "base")
    terms = term_spans(docs, base, doc_id, text)
    rows = base.select("id", "th", "s", "kind", "e", F.lit("mask").alias("action"), F.lit("").alias("general")).unionByName(terms.select("id", "th", "s", F.lit(len(KINDS)).alias("kind"), "e", "action", "general"))
    return stored(rows.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("s", "kind", "e", "action", "general"))).alias("spans")), "spans")


def report(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and what is done with terms: actions
    (action:start:end, and with what a term is generalised to, a beginning or nothing, by start)."""
    sp = all_spans(docs, doc_id, text)
    d = docs.select(*_key(docs, doc_id, text)).join(bounded_broadcast(sp, 100_000), ["id", "th"], "left")
    names = F.array(*[F.lit(k) for k, _, _ in KINDS], F.lit("term"))
    said = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", F.get(names, x.kind), x.s, x.e)))
    own = F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))
    base = F.filter(own, lambda x: x.kind < len(KINDS))
    done = F.concat_ws(",", F.transform(F.filter(own, lambda x: x.kind == len(KINDS)), lambda x: F.concat_ws(":", x.action, x.s, x.e, F.when(x.action == "generalise", x.general))))
    count = lambda i: F.size(F.filter(own, lambda x: x.kind == i)).cast("long")
    return d.select(key_id(F.col("id")).alias(doc_id), *[count(i).alias(f"n_{k}") for i, (k, _, _) in enumerate(KINDS)], F.sha2(said(base), 256).alias("base_sha256"), said(own).alias("spans"), done.alias("actions"))


def sanitise(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """docs with masked base spans, and disclosing terms removed or generalised; n_chars follows if there is one."""
    sp = all_spans(docs, doc_id, text)
    # of overlapping spans the first stays
    free = F.aggregate("spans", F.array().cast(f"array<{SPAN}>"), lambda a, x: F.when(F.coalesce(F.try_element_at(a, F.lit(-1)).e, F.lit(0)) <= x.s, F.concat(a, F.array(x))).otherwise(a))
    sp = sp.select("id", "th", free.alias("spans"))
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *_key(docs, doc_id, text))
    d = d.join(bounded_broadcast(sp, 100_000), ["id", "th"], "left").select("row", "spans")
    t = F.col("row")[text]
    mask = F.array(*[F.lit(f"<{k.upper()}>") for k, _, _ in KINDS], F.lit("<TERM>"))
    start = lambda i: F.coalesce(F.get("spans", i - 1).e, F.lit(0)).cast("int")
    piece = lambda x, i: F.concat(F.substring(t, start(i) + 1, x.s.cast("int") - start(i)), F.when(x.action == "remove", "").when(x.general != "", F.concat(x.general, F.lit("*"))).otherwise(F.get(mask, x.kind)))
    tail = F.substring(t, F.try_element_at("spans", F.lit(-1)).e.cast("int") + 1, F.length(t))
    clean = F.when(F.size("spans") > 0, F.concat(F.concat_ws("", F.transform("spans", piece)), tail)).otherwise(t)
    d = d.select("row", clean.alias("clean"))
    return d.select(*[(F.col("clean") if c == text else F.length("clean").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


_PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
_HITS = " union all ".join(f"select doc_id, {k} as kind, regexp_extract_all(t, '{p}') as m, regexp_split_to_array(t, '{p}') as p from d" for k, p in enumerate(_PLAIN))
_PMI = f"log2((n_et + {SMOOTH} * n_e / total) / (n_t + {SMOOTH}) * total / n_e)"

#: The report of documents with unique ids, as DuckDB SQL.
SQL = rf"""with d as (select doc_id, text, coalesce(text, '') as t from documents), total as (select cast(count(*) as double) as total from documents),
a as ({_HITS}),
h as (select doc_id, kind, k, m[k] as val, length(p[k]) as gap from (select *, unnest(range(1, len(m) + 1)) as k from a where len(m) > 0)),
placed as (select *, cast(sum(gap + length(val)) over (partition by doc_id, kind order by k) as bigint) as e, regexp_replace(val, '[^0-9]', '', 'g') as num from h),
base as (select doc_id, kind, e - length(val) as s, e, kind || ':' || case kind when 0 then lower(val) when 1 then val else num end as ent from placed where case kind when 0 then true
 when 1 then list_bool_and(list_transform(string_split(val, '.'), lambda x: coalesce(length(ltrim(x, '0')) <= 3 and cast('0' || left(ltrim(x, '0'), 3) as int) <= 255, false)))
 when 2 then length(num) between 12 and 19 and list_sum(list_transform(range(length(num)), lambda i: case when i % 2 = 0 then cast(substr(num, length(num) - i, 1) as int) else cast(substr(num, length(num) - i, 1) as int) * 2 - case when cast(substr(num, length(num) - i, 1) as int) > 4 then 9 else 0 end end)) % 10 = 0
 else length(num) between 9 and 15 end),
cut as (select doc_id, s, e, coalesce(max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding), 0) as upto from base),
bl as (select doc_id, string_agg(substr(t, upto + 1, greatest(s, upto) - upto) || repeat(' ', e - greatest(s, upto)), '' order by s, e) || substr(any_value(t), max(e) + 1) as t from cut join d using (doc_id) where e > upto group by doc_id),
w as (select doc_id, k, lower(w[k]) as term, length(w[k]) as n, length(g[k]) as gap from (select *, unnest(range(1, len(w) + 1)) as k from (select doc_id, regexp_extract_all(t, '\p{{L}}[\p{{L}}\p{{N}}]{{2,}}') as w, regexp_split_to_array(t, '\p{{L}}[\p{{L}}\p{{N}}]{{2,}}') as g from bl))),
wp as (select doc_id, term, cast(sum(gap + n) over (partition by doc_id order by k) as bigint) as e, n from w),
n_e as (select ent, count(distinct doc_id) as n_e from base group by ent),
n_t as (select term, count(distinct doc_id) as n_t from (select doc_id, lower(unnest(regexp_extract_all(text, '\p{{L}}[\p{{L}}\p{{N}}]{{2,}}'))) as term from documents) group by term),
et as (select ent, term, count(*) as n_et from (select distinct doc_id, ent from base) join (select distinct doc_id, term from wp) using (doc_id) group by ent, term),
told as (select ent, term, n_e, case when n_et >= {EVIDENCE} and {_PMI} >= {REMOVE} * log2(total / n_e) then 'remove' else 'generalise' end as action from et join n_e using (ent) join n_t using (term), total where log2(total / n_e) > 0 and {_PMI} >= {GENERALISE} * log2(total / n_e)),
stem as (select left(term, l) as stem, sum(n_t) as n_t from n_t, (select unnest({[*LADDER]}) as l) where length(term) > l group by 1),
gen as (select term, n_e, arg_max(stem, l) as general from (select distinct term, n_e from told where action = 'generalise') a, (select unnest({[*LADDER]}) as l), total, stem where length(term) > l and stem = left(term, l)
 and not (log2(total / n_e) > 0 and log2((n_e + {SMOOTH} * n_e / total) / (stem.n_t + {SMOOTH}) * total / n_e) >= {GENERALISE} * log2(total / n_e)) group by term, n_e),
of_doc as (select doc_id, term, max(action) as action, min(coalesce(general, '')) as general from (select distinct doc_id, ent from base) join told using (ent) left join gen using (term, n_e) group by doc_id, term),
spans as (select doc_id, s, kind, e, '' as what from base union all select doc_id, e - n, {len(KINDS)}, e, action || ':' || (e - n) || ':' || e || case when action = 'generalise' then ':' || general else '' end from wp join of_doc using (doc_id, term)),
said as (select doc_id, string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e) as spans,
 string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind, e) filter (kind < {len(KINDS)}) as own, string_agg(what, ',' order by s) filter (kind = {len(KINDS)}) as actions,
 {", ".join(f"count(*) filter (kind = {k}) as n_{n}" for k, (n, _, _) in enumerate(KINDS))} from spans group by doc_id)
select doc_id, {", ".join(f"cast(coalesce(n_{n}, 0) as bigint) as n_{n}" for n, _, _ in KINDS)}, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(actions, '') as actions from d left join said using (doc_id)"""
