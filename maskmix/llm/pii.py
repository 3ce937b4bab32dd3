"""Personal data and the terms that give it away (DataFrame operations only).

Base: emails, IP addresses, card numbers and phone numbers are found by pattern. Method: for every protected
entity (a base value) the corpus gives the terms of the documents that hold it; the pointwise mutual information of term
and entity, as a share of the entity's own information content, is the term's disclosure. In a document that
holds the entity, terms that disclose at least ``generalise_at`` of it are generalised to
their shape, at least ``remove_at`` removed, wherever in the text they stand. No entity has to recur: the share of a term's texts that hold the
entity is taken at the lower end of its Wilson interval, so that few texts prove less than many. Equal texts
count once, so that copies of one document prove nothing.

All counts are partial aggregates over (entity, term) or term; nothing is grouped by document but its own spans. Rows
without base spans pass through; only those with some, by the hash of their text, meet the spans.

Defined cases: null text is empty and holds nothing; repeated rows get the same spans; the result has one row
per input row; an empty table gives no rows; other columns are carried along, whatever their names, but ``find_base``
and ``spans_of`` replace columns named like their results. Offsets are code points, ends exclusive. Base spans
always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskmix.llm.common import discard, documents, packed, save, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Each finds what the contract's pattern finds, leftmost first. A match starts at a run's start or where the
#: last one ended, and runs are never given back, so that no text costs more than linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
HOLDS = {"email": "contains(t, '@')", "ip": "contains(t, '.')", "card": "true", "phone": "contains(t, '+')"}
VALID = {
    "email": "true",
    "ip": r"forall(split(x.m, '\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": "length(regexp_replace(x.m, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(x.m, '[^0-9]', ''))",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 9 and 15",
}
#: A term is a run of letters or digits, short ones too.
TERM = r"[\p{L}\p{N}]++"
HITS = "array<struct<s:int,m:string>>"
#: See ``disclosures``.
FREQUENT = 100
#: Standard deviations of the Wilson interval (95 %).
Z = 1.96


def sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> str:
    """SQL for all matches with their starts: pieces between matches and the matches themselves, measured in turn."""
    return f"""transform(array(named_struct('p', split({text}, {sql(pattern)}), 'h', regexp_extract_all({text}, {sql(pattern)}, 0))), z ->
        aggregate(z.h, named_struct('at', 0, 'n', 0, 'out', cast(array() as {HITS})), (a, h) -> named_struct(
            'at', a.at + length(z.p[a.n]) + length(h), 'n', a.n + 1, 'out', concat(a.out, array(named_struct('s', a.at + length(z.p[a.n]), 'm', h)))), a -> a.out))[0]"""


SPANS = "array<struct<k:string,s:int,e:int,m:string>>"
EXTRA = "array<struct<k:string,s:int,e:int,action:string>>"


def base_of(t: str = "t") -> Column:
    """Array of (k, s, e, m), by kind as listed, then start, of the text ``t`` (not null)."""
    parts = []
    for k in KINDS:
        hits = f"case when {HOLDS[k]} then {matches('t', PATTERNS[k])} else cast(array() as {HITS}) end"
        parts.append(f"transform(filter({hits}, x -> {VALID[k]}), x -> named_struct('k', '{k}', 's', x.s, 'e', x.s + length(x.m), 'm', x.m))")
    return F.expr(f"concat({', '.join(parts)})")


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``base``."""
    rows = packed(docs, t=F.coalesce(F.col(text), F.lit(""))).withColumn("base", base_of())
    return rows.select(*unpacked(rows, ("base",)), "base")


def term_set(text: str) -> Column:
    """The different terms of a text, lower-cased one by one as those of ``positions`` are."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower))


def lower_bound(n: Column, of: Column) -> Column:
    """Lower end of the Wilson interval of the share ``n / of``."""
    p = n.cast("double") / of
    spread = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / of + Z * Z / (4 * of * of))
    return (p + Z * Z / (2 * of) - Z * spread) / (1 + Z * Z / of)


def entity_of(b: Column) -> Column:
    return F.concat(b["k"], F.lit(":"), F.when(b["k"].isin("card", "phone"), F.regexp_replace(b["m"], "[^0-9]", "")).otherwise(F.lower(b["m"])))


def disclosures(held: DataFrame, docs: DataFrame, text: str = "text", generalise_at: float = 0.75, remove_at: float = 0.9) -> DataFrame:
    """``h, term, action`` for the terms of the texts in ``held`` (h, t, entities; h is the text's hash) that disclose
    too much of one of their entities; saved."""
    entities = held.select("h", F.explode("entities").alias("entity")).distinct()
    numbers = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # The entities of one text only all have the same terms and figures: one stands for all.
    alone = F.when(F.col("n_entity") == 1, F.concat(F.lit("text:"), F.col("h"))).otherwise(F.col("entity"))
    entities = save(entities.join(numbers, "entity").select("h", alone.alias("entity"), "n_entity").distinct())

    # Terms by the number of different texts: a text that occurs n times counts an n-th each time. The few texts that
    # recur are a table of their own, so that the texts only travel if that one is too large to broadcast.
    texts = docs.select(F.xxhash64(F.col(text)).alias("x"), F.col(text).alias("t"))
    copies = save(texts.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    again = save(copies.where("n > 1"))
    n_all = copies.count()
    terms = texts.join(again, "x", "left").select(F.explode(term_set("t")).alias("term"), (1 / F.coalesce("n", F.lit(1))).alias("share"))
    terms = terms.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_term"))

    # The bound is at most n_entity / n_term, so a term in more texts than this cannot reach generalise_at.
    reach = lambda n: F.pow(n, F.lit(generalise_at)) * F.lit(float(n_all) ** (1 - generalise_at) * 1.000001)
    most = F.lit(entities.agg(F.coalesce(F.max("n_entity"), F.lit(0))).first()[0])
    rare = terms.where(F.col("n_term") <= reach(most))
    # Terms of more than a FREQUENT-th of the texts, of which there are fewer than FREQUENT times a text's terms, go first.
    frequent = terms.where((F.col("n_term") > reach(most)) & (F.col("n_term") * FREQUENT > n_all)).select("term")
    words = held.select("h", F.explode(term_set("t")).alias("term")).join(F.broadcast(frequent), "term", "left_anti").distinct()
    # Exploded rows look small to the planner, which must not broadcast them.
    words = words.hint("merge").join(rare, "term")
    pairs = save(words.join(entities, "h").where(F.col("n_term") <= reach(F.col("n_entity"))))
    rows = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    content = F.log2(F.lit(float(n_all)) / F.col("n_entity"))
    pmi = F.log2(lower_bound(F.col("n_both"), F.col("n_term"))) + content
    rows = rows.withColumn("disclosure", F.when(content > 0, pmi / F.greatest(content, F.lit(1e-9))).otherwise(F.lit(0.0)))
    rows = rows.where(F.col("disclosure") >= generalise_at).select("entity", "term", F.when(F.col("disclosure") >= remove_at, F.lit("removed")).otherwise(F.lit("generalised")).alias("action"))
    told = save(pairs.select("h", "entity", "term").join(rows, ["entity", "term"]).groupBy("h", "term").agg(F.max("action").alias("action")))
    discard(entities, copies, again, pairs)
    return told


def positions(held: DataFrame) -> DataFrame:
    """One row per term of a text, wherever it stands: ``h, term, s, e``; ends are running sums, not quadratic."""
    rows = held.select("h", F.split("t", TERM).alias("p"), F.regexp_extract_all("t", F.lit(TERM), F.lit(0)).alias("m"))
    rows = rows.select("h", F.posexplode(F.expr("transform(m, (x, i) -> named_struct('gap', length(p[i]), 'm', x))")).alias("i", "x"))
    end = F.sum(F.col("x.gap") + F.length("x.m")).over(Window.partitionBy("h").orderBy("i")).cast("int")
    return rows.withColumn("e", end).select("h", F.lower("x.m").alias("term"), (F.col("e") - F.length("x.m")).alias("s"), "e")


def found(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``row, t, base, extra``: the packed row, its text (null as empty), and its spans."""
    rows = packed(docs, t=F.coalesce(F.col(text), F.lit(""))).withColumn("base", base_of())
    own = save(rows.where(F.size("base") > 0).withColumn("h", F.xxhash64("t")))
    held = save(own.select("h", "t", "base", F.array_distinct(F.transform("base", entity_of)).alias("entities")).dropDuplicates(["h"]))
    told = disclosures(held, docs, text, **limits)
    spans = positions(held.join(told.select("h").distinct(), "h", "left_semi")).hint("merge").join(told, ["h", "term"])
    extra = spans.groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("k"), "s", "e", "action"))).alias("extra"))
    # Terms that touch a base span go with it.
    extra = save(extra.join(held.select("h", "base"), "h").select("h", F.expr("filter(extra, y -> not exists(base, z -> z.s < y.e and y.s < z.e))").alias("extra")))
    none = F.expr(f"cast(array() as {EXTRA})")
    discard(held, told)
    own = own.join(extra, "h", "left").select("row", "t", "base", F.coalesce("extra", none).alias("extra"))
    return rows.where(F.size("base") == 0).select("row", "t", F.expr(f"cast(array() as {SPANS})").alias("base"), none.alias("extra")).union(own)


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.k, x.s, x.e)), ',')"


def spans_of(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` plus ``base`` and ``extra``."""
    rows = found(docs, text, **limits)
    return rows.select(*unpacked(rows, ("base", "extra")), "base", "extra")


def sanitise(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents with base spans replaced by their kind, and telling terms generalised or removed.

    Overlapping spans are replaced as one, by the first one's label. A generalised term becomes its shape:
    a number, a name (if capitalised) or a word. ``n_chars`` follows the text; a null text stays null.
    """
    rows = found(docs, text, **limits)
    first = "substring(t, x.s + 1, 1)"
    label = f"case when x.action = 'removed' then '' when {first} rlike '[0-9]' then '[number]' when {first} rlike '\\\\p{{Lu}}' then '[name]' else '[word]' end"
    flat = f"array_sort(concat(transform(base, x -> named_struct('s', x.s, 'e', x.e, 'r', concat('[', x.k, ']'))), transform(extra, x -> named_struct('s', x.s, 'e', x.e, 'r', {label}))))"
    kind = "array<struct<s:int,e:int,r:string>>"
    merged = f"""aggregate({flat}, named_struct('cur', cast(null as struct<s:int,e:int,r:string>), 'out', cast(array() as {kind})), (a, x) -> case
        when a.cur is null then named_struct('cur', x, 'out', a.out)
        when x.s < a.cur.e then named_struct('cur', named_struct('s', a.cur.s, 'e', greatest(a.cur.e, x.e), 'r', a.cur.r), 'out', a.out)
        else named_struct('cur', x, 'out', concat(a.out, array(a.cur))) end, a -> concat(a.out, array(a.cur)))"""
    rows = rows.withColumn("spans", F.expr(f"case when size(base) + size(extra) > 0 then {merged} else cast(array() as {kind}) end"))
    pieces = "transform(spans, (x, i) -> concat(substring(t, if(i = 0, 0, get(spans, i - 1).e) + 1, x.s - if(i = 0, 0, get(spans, i - 1).e)), x.r))"
    own = F.col("row").getField(text)
    rows = rows.withColumn("clean", F.when(F.size("spans") == 0, own).otherwise(F.expr(f"concat(array_join({pieces}, ''), substring(t, element_at(spans, -1).e + 1))")))
    new = {text: F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    both = F.expr(joined("concat(transform(base, x -> named_struct('k', x.k, 's', x.s, 'e', x.e)), transform(extra, x -> named_struct('k', x.k, 's', x.s, 'e', x.e)))"))
    return rows.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), both.alias("spans"))
