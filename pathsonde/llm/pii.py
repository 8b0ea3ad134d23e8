"""Personal data by patterns, and the terms that give it away by co-occurrence.

The patterns find protected entities: mail addresses, IP addresses, card numbers, phone numbers, and secrets,
which are long mixed runs of letters and digits. An entity also counts as its part (a mail domain, the first half
of an IP address, the issuer of a card, the prefix of a phone number) and as its kind. Over the corpus, the
pointwise mutual information of a term with an entity, as a share of the entity's own information
content, says how strongly the term reveals it (Sanchez and Batet, "C-sanitized", 2016): 1 if the term
occurs only with the entity, 0 if both are independent. Terms over the upper threshold are removed, those
over the lower one generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathsonde.llm.common import cut, free_name, release, shuffled

#: The patterns, with possessive repeats and looks behind that keep them linear but change no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans are listed.
KINDS = (*PATTERNS, "generalise", "remove")
#: Different characters of a secret, at least.
SECRET_CHARS = 8
#: Distinct texts in which term and entity meet at least; bits of surprise that the texts of a term make up if it were independent; shares of the entity's information.
MIN_TEXTS, EVIDENCE, GENERALISE_AT, REMOVE_AT = 3, 16.0, 0.95, 0.999
MIN_LETTERS = 4
LABELS = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]", "secret": "[secret]", "generalise": "[term]", "remove": ""}
#: Bytes of terms that may be sent to every task.
SMALL = 16_000_000
#: Hits that are placed together; positions are summed up within such a block and from block to block.
BLOCK = 128

SPAN = "struct<start: int, end: int, value: string>"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= SECRET_CHARS)
    return F.lit(True)


def spans_of(text: Column, pattern: str, keep) -> Column:
    """Matches of ``pattern`` that ``keep`` admits, as array<struct<start, end, value>> in code points."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    parts = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit")))

    none = F.expr(f"cast(array() as array<{SPAN}>)")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        return state(end, F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["out"], one)).otherwise(acc["out"]))

    def placed(all_parts: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(all_parts, k * BLOCK + 1, F.lit(BLOCK)), state(acc["at"], none), step)
            return F.transform(F.array(own), lambda o: state(o["at"], F.when(F.size(o["out"]) > 0, F.concat(acc["out"], F.array(o["out"]))).otherwise(acc["out"])))[0]

        blocks = F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / BLOCK).cast("int"))
        many = F.aggregate(blocks, state(F.lit(0), F.array(none)), block, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(all_parts) <= BLOCK, F.aggregate(all_parts, state(F.lit(0), none), step, lambda acc: acc["out"])).otherwise(many)

    return F.transform(F.array(parts), placed)[0]  # so that the parts are made once


def base_spans(df: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """Add a column of valid matches for each kind of PATTERNS, named by ``names``."""
    c = F.col(text)
    some = {"email": c.contains("@"), "ip": c.rlike(r"[0-9]\.[0-9]"), "card": c.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": c.contains("+"), "secret": c.rlike("[0-9]") & c.rlike("(?<![A-Za-z0-9])[A-Za-z0-9]{16}")}
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return df.withColumns({names[k]: F.when(some[k], spans_of(c, p, _keeps(k))).otherwise(none) for k, p in PATTERNS.items()})


def words_of(text: Column) -> Column:
    """Distinct lower-case runs of at least MIN_LETTERS letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+", -1), lambda w: F.char_length(w) >= MIN_LETTERS))


def _names(kind: str) -> Column:
    """What the values of the column ``kind`` are called: each value and its part."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    plain = digits if kind in ("card", "phone") else (lambda v: v) if kind == "secret" else F.lower
    part = {
        "email": lambda v: F.substring_index(v, "@", -1), "ip": lambda v: F.substring_index(v, ".", 2), "card": lambda v: F.substring(v, 1, 6), "phone": lambda v: F.substring(v, 1, 5),
    }.get(kind)
    values = F.transform(kind, lambda s: plain(s["value"]))
    own = F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    return own if part is None else F.concat(own, F.transform(values, lambda v: F.concat(F.lit(f"{kind}~"), part(v))))


def _spans_as(column: str | Column, kind: str) -> Column:
    return F.transform(column, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _keeps(kind: str):
    return lambda m: _valid(kind, m)


def _outside(text: Column, spans: Column) -> Column:
    """The text without the spans, which may overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat_ws(" ", acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))


def _holders(df: DataFrame, text: str) -> DataFrame:
    """``(h, copies, kinds, names, mark, words)`` of each distinct text with entities: the rows that hold it, kinds, names and a hash of its entities, and its words beside them."""
    own = base_spans(df.select(F.col(text).alias("text"), F.xxhash64(text).alias("h")), "text", {k: k for k in PATTERNS})
    own = own.filter(" or ".join(f"size({k}) > 0" for k in PATTERNS))
    kinds = F.filter(F.array(*[F.when(F.size(k) > 0, F.lit(k)) for k in PATTERNS]), lambda k: k.isNotNull())
    names = F.array_distinct(F.concat(*[_names(k) for k in PATTERNS]))
    words = words_of(_outside(F.col("text"), F.concat(*PATTERNS)))
    own = own.select("h", kinds.alias("kinds"), names.alias("names"), words.alias("words"))
    one = own.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("kinds", "names", "words")])
    return one.withColumn("mark", F.xxhash64(F.array_sort("names")))


def disclosing_terms(df: DataFrame, text: str = "text", min_texts: int = MIN_TEXTS, evidence: float = EVIDENCE, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """``(term, action, share)`` for the terms that reveal an entity, from all rows of ``df``.

    An entity is a value, a value's part or a whole kind. A term and an entity meet where a text holds both,
    the term outside of all values. They have to meet in at least ``min_texts`` distinct texts, which would be a surprise of at
    least ``evidence`` bits if the term were independent of the entity; a part or kind has to be met with
    different sets of values, so that copies of one text do not speak for it. Otherwise counts are of rows.
    ``share`` is the mutual information over the entity's information content, the largest over all entities.

    Values in fewer texts are left out before they meet terms. So are terms in more rows than any that reach
    ``generalise_at`` with an entity, as both meet in no more rows than the entity has. Null texts have no terms.
    """
    total = df.count()
    holders = cut(_holders(df, text))
    of = lambda c: holders.select("h", "copies", F.explode(c).alias("entity"))
    sizes = of(F.concat("names", "kinds")).groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("n"))
    most = F.pow(F.lit(float(max(total, 1))), F.lit(1 - generalise_at)) * F.pow(F.col("n_entity").cast("double"), F.lit(generalise_at)) * (1 + 1e-9)
    sizes = cut(sizes.filter((F.col("n") >= min_texts) & (F.col("n_entity") < total)).select("entity", "n_entity", most.alias("most")))
    limit = sizes.agg(F.max("most")).first()[0] or 0.0
    terms = df.select(F.explode(words_of(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    terms = cut(terms.filter((F.col("n_term") >= min_texts) & (F.col("n_term") <= limit)))

    known = of("names").join(sizes.select("entity"), "entity", "left_semi").groupBy("h").agg(F.collect_set("entity").alias("known"))
    met = shuffled(holders.select("h", "copies", "kinds", "mark", "words")).join(known, "h", "left")
    none = F.expr("cast(array() as array<string>)")
    met = met.select("copies", "mark", "words", F.explode(F.concat("kinds", F.coalesce("known", none))).alias("entity")).select("copies", "mark", "entity", F.explode("words").alias("term"))
    pairs = met.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("n_texts"), F.min("mark").alias("a"), F.max("mark").alias("b"))
    single = F.col("entity").contains(":")
    pairs = pairs.filter((F.col("n_texts") >= min_texts) & (single | (F.col("a") != F.col("b")))).drop("a", "b")
    pairs = pairs.join(sizes, "entity").join(terms, "term").filter("n_term <= most")
    rarity = F.log2(F.lit(total) / F.col("n_entity"))
    mutual = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    counted = pairs.filter(F.col("n_texts") * rarity >= evidence).withColumn("share", mutual / rarity)
    best = cut(counted.groupBy("term").agg(F.max("share").alias("share")).filter(F.col("share") >= generalise_at))
    release(holders, sizes, terms)
    return best.select("term", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"), "share")


def _met(df: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """``(h, hits)``: the terms and actions that each distinct text holds."""
    each = df.select(F.xxhash64(text).alias("h"), F.explode(words_of(F.col(text))).alias("term")).join(terms, "term")
    return each.groupBy("h").agg(F.collect_set(F.struct("term", "action")).alias("hits"))


def find_spans(df: DataFrame, text: str = "text", out: str = "spans", terms: DataFrame | None = None) -> DataFrame:
    """Add ``out``: all spans of ``text`` as array<struct<kind, start, end>>, by KINDS and then start.

    Starts and ends are in code points, the end excluded. Base kinds are the leftmost non-overlapping
    matches of each pattern that pass its test; they stay whatever comes beside them. Secrets that overlap
    one are left out, and so are terms that overlap a base span or secret. ``terms`` are those of
    ``disclosing_terms``, by default of ``df`` itself.

    A null text has no spans. Rows are independent given the terms; copies count once for the terms.
    Input columns stay, but for one named like ``out``. An empty table gives no rows.

    Texts with terms are found by hashes; they are broadcast only if their terms, as counted, lie under SMALL bytes.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() == out.lower()])
    terms = cut((disclosing_terms(rows, text) if terms is None else terms).select("term", "action"))
    h, hits = free_name(rows, "_h"), free_name(rows, "_terms")
    names = {k: free_name(rows, f"_{k}") for k in PATTERNS}
    met = cut(_met(rows, text, terms)).select(F.col("h").alias(h), F.col("hits").alias(hits))
    size = met.select(F.aggregate(hits, F.lit(64).cast("long"), lambda n, t: n + F.octet_length(t["term"]) + 64).alias("n")).agg(F.sum("n")).first()[0] or 0
    own = rows.withColumn(h, F.xxhash64(text)).join(F.broadcast(met) if size <= SMALL else shuffled(met), h, "left")
    own = base_spans(own, text, names)
    base, secrets, added = (free_name(rows, f"_{x}") for x in ("base", "secrets", "added"))
    none = F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")
    free = lambda spans, taken: F.filter(spans, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    own = own.withColumn(base, F.concat(*[F.coalesce(_spans_as(names[k], k), none) for k in BASE]))
    own = own.withColumn(secrets, F.coalesce(_spans_as(free(F.col(names["secret"]), F.col(base)), "secret"), none))
    own = own.withColumn(base, F.concat(base, secrets))
    flagged = F.transform(F.col(hits), lambda t: t["term"])
    placed = F.when(F.col(hits).isNotNull(), spans_of(F.col(text), r"\p{L}+", lambda m: F.array_contains(flagged, F.lower(m))))
    own = own.withColumn(added, placed)
    action = lambda s: F.element_at(F.filter(hits, lambda t: t["term"] == F.lower(s["value"])), 1)["action"]
    more = F.transform(free(F.col(added), F.col(base)), lambda s: F.struct(action(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    parted = [of_kind(more, k) for k in ("generalise", "remove")]
    both = F.when(F.col(hits).isNull(), F.col(base)).otherwise(F.concat(F.col(base), *parted))
    return own.withColumn(out, both).select(*rows.columns, out)


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_base(s: Column) -> Column:
    return s["kind"].isin(*BASE)


def sanitise(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace the spans of ``text`` by their LABELS; where spans overlap, the first one's label stands for all."""
    label = lambda k: F.coalesce(*[F.when(k == x, F.lit(v)) for x, v in LABELS.items()])
    c = F.col(text)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(c, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, label(s["kind"]))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substr(c, acc["at"] + 1, F.char_length(c))))
    return df.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(c))
