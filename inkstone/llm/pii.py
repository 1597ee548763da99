"""Personal data: patterns, and terms that give the protected entities away (operator 8), without Python on the executors.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers; the values found are the protected
entities. Information-theoretic sanitisation then asks which other terms disclose them: over the distinct texts of the
corpus, and over its distinct lines, the smoothed point-wise mutual information of a term and an entity, as a share of the
entity's own information content, is the part of it that the term reveals. Terms above REMOVE are removed and terms above
GENERALISE are replaced by their kind, in the documents that hold the entity; the greater of both shares counts. How
often both stand together must be more than chance explains: its tail bound, times the number of different words in the
corpus (each could have met the entity; a HyperLogLog estimate, which enters as a logarithm), must be at most CHANCE. This
judges an entity on one line as well as a frequent one: one meeting proves much where few words are rare, and nothing in a
corpus in which most texts have words of their own.

Equal lines (and equal texts) count once. No line travels for that: a line found n times counts 1/n each time, and n is a
count over 64-bit hashes, kept for lines found more than once only. Of the words of lines only candidates are counted, by 64-bit
hashes too: two words of one hash would count as one, which makes either disclose less.

Places are code points, ends exclusive. Nulls count as empty texts, which have no spans. Repeated rows each give a row,
rows with a null id are treated as any other, an empty table gives none. Terms with equal shares are all kept; of spans that
begin at one place `sanitise` takes the longest, then the first kind by name. Columns to keep travel inside one struct, so
their names clash with nothing; other columns are not looked at. Very long texts are read whole.

The patterns are written so that a match begins at the leftmost place and no engine backtracks: a run that fails is not
tried again from its middle. Long runs without a match therefore cost time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored, words

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PARTS_OK = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}"
#: Shares of an entity's information that a term reveals, from which on it is generalised or removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Chance at most, over all words of the corpus, that one stands beside an entity so often without disclosing it.
CHANCE = 0.05
#: Occurrences of a term as if without the entity more than with it, against which its share is smoothed.
SMOOTH = 0.5
#: Bytes of candidate terms, or of documents' disclosing ones, that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 8_000_000
SPAN = "array<struct<s:int,e:int,v:string>>"


def places(text: Column, pattern: Column) -> Column:
    """Where the pattern is found: what lies between matches gives their places."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["gap"])
        e = s + F.length(x["v"])
        return F.struct(F.coalesce(e, s).alias("at"), F.when(x["v"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))))).alias("out"))

    return F.when(F.regexp_like(text, pattern), F.aggregate(found, start, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))

    def step(a: Column, i: Column) -> Column:
        x = F.ascii(F.substring(d, i, F.lit(1))) - 48
        y = F.when(i % 2 == 0, x * 2).otherwise(x)
        return a + F.when(y > 9, y - 9).otherwise(y)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the spans that pass its test."""
    none = F.array().cast(SPAN)
    phone_digits = lambda x: F.length(_digits(x["v"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), places(text, F.lit(EMAIL))).otherwise(none),
        "ip": F.filter(places(text, F.lit(IP)), lambda x: x["v"].rlike(PARTS_OK)),
        "card": F.filter(places(text, F.lit(CARD)), lambda x: luhn(x["v"])),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(places(text, F.lit(PHONE)), lambda x: phone_digits(x).between(8, 15))).otherwise(none),
    }


def _entity(kind: str, v: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(v) if kind == "email" else (v if kind == "ip" else _digits(v)))


def _entities(spans: dict[str, Column]) -> Column:
    def of(kind: str, c: Column) -> Column:
        return F.transform(c, lambda x: _entity(kind, x["v"]))

    return F.array_distinct(F.concat(*(of(k, c) for k, c in spans.items())))


def beside(text: Column, spans: dict[str, Column]) -> Column:
    """What may give an entity away: the distinct words of a text that no base span touches, identifiers and numbers among them.

    The text is cut at the spans, and what is left of a word that a span goes into is cut off its pieces."""
    order = F.array_sort(F.concat(*(F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for c in spans.values())))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    after = lambda piece: F.regexp_replace(piece, r"^[^\x20\x09-\x0D]++", "")
    before = lambda piece: F.regexp_replace(piece, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++$", "")

    def step(a: Column, x: Column) -> Column:
        piece = F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        piece = before(F.when(a["at"] > 0, after(piece)).otherwise(piece))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))

    def last(a: Column) -> Column:
        piece = F.substring(text, a["at"] + 1, F.length(text))
        return F.concat(a["out"], F.array(F.when(a["at"] > 0, after(piece)).otherwise(piece)))

    return F.array_distinct(F.flatten(F.transform(F.aggregate(order, start, step, last), words)))


def _share(cet: Column, ct: Column, ce: Column, n: Column) -> Column:
    """Part of an entity's information that a term reveals."""
    p = ce / n
    return F.log2((cet + F.lit(SMOOTH) * p) / (ct + F.lit(SMOOTH)) / p) / F.greatest(-F.log2(p), F.lit(1e-9))


def _beyond_chance(cet: Column, ct: Column, ce: Column, n: Column, compared: Column) -> Column:
    """Chernoff's bound of a Poisson tail, for one occurrence the tail itself, against CHANCE over all words compared."""
    mean = ct * ce / n
    bound = F.when(cet <= 1, F.log(-F.expm1(-mean))).otherwise(-(cet * F.log(cet / mean) - cet + mean))
    return (cet > mean) & (bound + F.log(compared) <= F.log(F.lit(CHANCE)))


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if all its values together have at most BROADCAST_BYTES."""
    of = lambda c, kind: F.lit(8) if kind in ("bigint", "double") else F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long")
    size = sum((of(c, kind) for c, kind in df.dtypes), F.lit(16).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES else df.hint("merge")


def _disclosed(held: DataFrame, units: DataFrame, compared: int) -> DataFrame:
    """entity, term, share over units (lines or texts). held: entities and terms of the distinct units that hold any; units: u of all, with repeats."""
    again = stored(units.groupBy(F.xxhash64("u").alias("h")).agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    total = F.lit(float(max(1, units.count() - (again.agg(F.sum(F.col("times") - 1).alias("n")).first()["n"] or 0))))
    words_ = F.lit(float(max(1, compared)))
    own = held.select("entities", F.explode("terms").alias("term"))
    # on how many units with any entity a term stands is at most on how many units it stands at all
    seen = own.groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    n_entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("ce"))
    pairs = own.select(F.explode("entities").alias("entity"), "term").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("cet"))
    # term and entity each stand on cet units at least: pairs too rare even so, nearly all of them, go before any join
    pairs = pairs.where(_beyond_chance(F.col("cet"), F.col("cet"), F.col("cet"), total, words_))
    pairs = pairs.join(n_entity, "entity").join(seen, "term")
    possible = (_share(F.col("cet"), F.col("least"), F.col("ce"), total) >= GENERALISE) & _beyond_chance(F.col("cet"), F.col("least"), F.col("ce"), total, words_)
    pairs = stored(pairs.where(possible).drop("least"))
    # where candidates are too many to be broadcast, every word of every unit travels to meet them: as a number, not as a text
    wanted = _small(pairs.select(F.xxhash64("term").alias("k")).distinct())
    every = units.select(F.xxhash64("u").alias("h"), F.explode(F.array_distinct(words(F.col("u")))).alias("term"))
    hits = every.select("h", F.xxhash64("term").alias("k")).join(wanted, "k", "left_semi")
    n_term = hits.join(again, "h", "left").groupBy("k").agg(F.round(F.sum(1 / F.coalesce("times", F.lit(1)))).alias("ct"))
    told = _beyond_chance(F.col("cet"), F.col("ct"), F.col("ce"), total, words_)
    return pairs.withColumn("k", F.xxhash64("term")).join(n_term, "k").where(told).select("entity", "term", _share(F.col("cet"), F.col("ct"), F.col("ce"), total).alias("share")).where(F.col("share") >= GENERALISE)


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity, term, share: terms that reveal at least GENERALISE of an entity. found: text, entities of the documents that hold any."""
    whole = found.select(F.col("text").alias("u")).distinct()
    lines = found.select(F.explode(F.split("text", "\n")).alias("u"))
    lines = lines.where(lines["u"].rlike("[0-9]|@")).distinct()
    with_terms = lambda df: df.select("u", *(c.alias(k) for k, c in base_spans(F.col("u")).items())).select(_entities({k: F.col(k) for k in KINDS}).alias("entities"), beside(F.col("u"), {k: F.col(k) for k in KINDS}).alias("terms")).where(F.size("entities") > 0)
    all_ = documents(docs)
    compared = all_.select(F.explode(words(F.col("text"))).alias("w")).agg(F.approx_count_distinct("w", 0.01).alias("n")).first()["n"]
    by_line = _disclosed(stored(with_terms(lines)), all_.select(F.explode(F.split("text", "\n")).alias("u")), compared)
    by_text = _disclosed(stored(with_terms(whole)), all_.select(F.col("text").alias("u")), compared)
    return by_line.unionByName(by_text).groupBy("entity", "term").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or a struct `own` of the columns to keep), text, n_email, n_ip, n_card, n_phone, base and spans: arrays of kind, s, e
    in the order of kinds, then places.

    kind is one of KINDS, or `remove` or `generalise` for terms that disclose an entity of the document."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("long").alias("doc_id") if keep is None else F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in keep)).alias("own")
    first = "doc_id" if keep is None else "own"
    df = docs.select(own, whole.alias("text"))
    df = df.select(first, "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    df = df.withColumn("entities", _entities({k: F.col(k) for k in KINDS}))
    # written, since both the size check and the result need them
    held = stored(df.where(F.size("entities") > 0).select("text", "entities"))
    shown = stored(disclosures(docs, held))
    per_doc = held.select(F.col("text").alias("t"), F.explode("entities").alias("entity")).select(F.sha2("t", 256).alias("th"), "entity").distinct()
    per_doc = per_doc.join(shown, "entity").groupBy("th", "term").agg(F.max("share").alias("share"))
    per_doc = stored(per_doc.groupBy("th").agg(F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone"), F.collect_list(F.when(F.col("share") < REMOVE, F.col("term"))).alias("vague")))
    # only texts with an entity can have such terms; the others get keys of their own, which match nothing and spread
    df = df.withColumn("th", F.when(F.size("entities") > 0, F.sha2("text", 256)).otherwise(F.xxhash64("text").cast("string")))
    df = df.join(_small(per_doc), "th", "left")

    def term_places(terms: Column) -> Column:
        plain = F.transform(F.array_sort(terms), lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}])", r"\\$1"))
        return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, places(F.col("text"), F.concat(F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.array_join(plain, "|"), F.lit(r")(?![^\x20\x09-\x0D])")))).otherwise(F.array().cast(SPAN))

    named = lambda k, c: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    df = df.withColumn("base", F.concat(*(named(k, F.col(k)) for k in KINDS)))
    df = df.withColumn("spans", F.concat("base", named("remove", term_places(F.col("gone"))), named("generalise", term_places(F.col("vague")))))
    return df.select(first, "text", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), "base", "spans")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitise(scanned: DataFrame) -> DataFrame:
    """scanned with `clean`: spans replaced by their kind, removed terms gone. Of overlapping spans the one that starts first counts."""
    tag = lambda x: F.when(x["kind"] == "remove", F.lit("")).when(x["kind"] == "generalise", F.lit("<TERM>")).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(a: Column, x: Column) -> Column:
        before = F.substring(text, a["at"] + 1, x["s"] - a["at"])
        return F.when(x["s"] < a["at"], a).otherwise(F.struct((-x["ne"]).alias("at"), F.concat(a["out"], before, tag(x)).alias("out")))

    done = F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return scanned.withColumn("clean", F.when(F.size("spans") > 0, done).otherwise(text))
