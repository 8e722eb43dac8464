"""Personal data with DataFrame functions alone: fixed patterns, and terms that disclose a protected entity.

Method. Every value that the patterns find (an address, a card number, a telephone) is a protected entity. Over all
documents: n(e) hold the entity, n(t) hold a term, n(e,t) have the term within ``CONTEXT`` words of the entity, N in all.
A term's disclosure of an entity is its pointwise mutual information with it over the entity's information content,
log(P(e|t) N / n(e)) / log(N / n(e)): 1 if the term gives the entity away, 0 if it says nothing.

Evidence. n(e,t) / n(t) says little where a term is seen once or twice, so P(e|t) is shrunk towards a prior:
(s n(e,t) / n(t) + STRENGTH * prior) / (s + STRENGTH), where s counts the distinct texts that have the term near the
entity, copies once. The prior is NAME for a term that stands there with a capital inside a sentence, as names do, and
WORD for any other. So a rare ordinary word next to an address stays until different texts put it there, and a
name goes at once unless it stands elsewhere too. A term is marked if its disclosure is DISCLOSURE or more and P(e|t) LEAST
or more, in a document that holds the entity, wherever it stands there, as kind ``term``; ``redact`` generalises all spans to
their kind. Where no protected entity is, there is nothing to disclose and no term is marked. In languages that write all
nouns with a capital, rare nouns next to an entity count as names.

How it runs. Texts without a digit or an at sign can hold no entity and are never shuffled. Of the others, entities and
terms are 64-bit hashes with a key made for the run, so that scratch tables hold no personal data. Copies of a text are
one row with a weight, and each word's documents are counted by one aggregation with partial sums.

Null and empty texts have no spans. A text of any length is read whole; repeated rows count as documents and get the
same spans; ties at the threshold are marked; an empty table gives an empty result. Extra columns pass through ``mark``
and ``redact``; the columns ``found`` and ``terms`` of ``mark`` replace inputs of the same name, ``redact`` keeps those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm import spans as S
from slotline.llm.common import table, written

KINDS = ("email", "ip", "card", "phone", "term")
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
# A match may begin where the one before ended, or where its first run of characters begins: the same matches as
# without that condition, found in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Every one of the four patterns needs one of these characters.
NEEDED = "[0-9@]"
CONTEXT = 4  #: words on either side
DISCLOSURE, LEAST = 0.8, 0.5
STRENGTH, NAME, WORD = 2.0, 0.9, 0.02  #: texts that the prior counts for, and the priors of names and other words
#: A word with a capital after a word, a number, a comma or an entity; it gets a mark, a letter that no text should have.
CAPITAL = r"(?<=(?:^|[\p{L}\p{N},;])[\x20])(?=\p{Lu}\p{Ll})"
MARKED = "\ua7ff"
TERM = r"[^\p{L}]+"
CHUNK = 256  #: matches whose words are counted together


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    at = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda t, i: t + worth(i))
    return total % 10 == 0


def _kinds() -> list[tuple[str, int, object]]:
    """Each kind's pattern, number, and test of a match."""
    card = lambda v: F.regexp_replace(v, "[ -]", "")
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    return [
        (EMAIL, 0, lambda v: F.lit(True)),
        (IP, 1, lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        (CARD, 2, lambda v: F.when(F.length(card(v)).between(13, 19), luhn(card(v))).otherwise(False)),
        (PHONE, 3, lambda v: digits(v).between(9, 15)),
    ]


def fixed(text: Column) -> Column:
    """Spans of the four patterns, failing matches dropped."""
    return F.concat(*[S.matches(text, pattern, kind, keep) for pattern, kind, keep in _kinds()])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: within one lambda it is a variable."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Lower-case words of letters, three or longer."""
    return F.filter(F.split(F.lower(text), TERM), lambda w: F.length(w) >= 3)


def hashed(word: Column, key: str) -> Column:
    """A word's hash; its last bit is free."""
    return F.xxhash64(F.lit(key), word).bitwiseAND(F.lit(-2))


def _hashed_words(gap: Column, key: str) -> Column:
    """Hashes of the gap's words in order, the last bit set for those with a capital inside a sentence."""
    marked = F.filter(F.split(F.lower(F.regexp_replace(gap, CAPITAL, MARKED)), TERM), lambda w: F.length(F.ltrim(w, F.lit(MARKED))) >= 3)
    return F.transform(marked, lambda w: hashed(F.ltrim(w, F.lit(MARKED)), key) + w.startswith(MARKED).cast("long"))


def _surrounded(text: Column, pattern: str, kind: int, keep, key: str) -> Column:
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"),
        F.transform(F.split(text, F.lit(pattern), -1), lambda g: _hashed_words(g, key)).alias("gaps"),
    )
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda t, n: t + n)

    def counted(p: Column) -> Column:
        """With all words end to end, how many each gap has, and how many stand before each chunk of gaps."""
        sizes = F.transform(p["gaps"], F.size)
        starts = F.sequence(F.lit(1), F.size(p["gaps"]), F.lit(CHUNK))
        sums = F.transform(starts, lambda c: total(F.slice(sizes, c, CHUNK)))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda seen, n: F.array_append(seen, F.element_at(seen, -1) + n))
        return F.struct(p["values"].alias("values"), F.flatten(p["gaps"]).alias("words"), sizes.alias("sizes"), before.alias("before"))

    def near(p: Column, i: Column) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        upto = F.get(p["before"], chunk) + total(F.slice(p["sizes"], chunk * CHUNK + 1, i - chunk * CHUNK + 1))
        left = F.slice(p["words"], F.greatest(upto - CONTEXT + 1, F.lit(1)), F.least(upto, F.lit(CONTEXT)))
        return F.array_distinct(F.concat(left, F.slice(p["words"], upto + 1, F.lit(CONTEXT))))

    def one(p: Column, v: Column, i: Column) -> Column:
        entity = F.xxhash64(F.lit(key), F.lit(kind), F.lower(v))
        return F.when(keep(v), F.struct(entity.alias("entity"), near(p, i).alias("near")))

    made = _let(_let(parts, counted), lambda p: F.transform(p["values"], lambda v, i: one(p, v, i)))
    none = F.array().cast("array<struct<entity:bigint,near:array<bigint>>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(made, lambda x: x.isNotNull())).otherwise(none)


def surrounded(text: Column, key: str) -> Column:
    """The entities of a text, each with the words near it (values of its kind between them are crossed), all hashed; the
    last bit of a word's hash tells whether it has a capital inside a sentence."""
    return F.concat(*[_surrounded(text, *kind, key) for kind in _kinds()])


def disclosing(documents: DataFrame, key: str) -> DataFrame:
    """(text_key, terms): for each text with a protected entity, the hashes of its terms that disclose one."""
    text = F.col("text")
    held = documents.filter(text.rlike(NEEDED))
    seen = held.select(F.xxhash64("text").alias("text_key"), F.posexplode(surrounded(text, key)).alias("at", "x"))
    seen = written(seen.select("text_key", "at", "x.entity", "x.near"), "entities")
    rows = seen.filter(F.col("at") == 0).groupBy("text_key").agg(F.count("*").alias("rows"))  # documents with that text
    near = seen.groupBy("text_key", "entity").agg(F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"))
    near = written(near.join(rows, "text_key"), "near")
    # written, so that the join with it has no aggregation in it and Spark can split an entity that very many texts hold
    entities = written(near.groupBy("entity").agg(F.sum("rows").alias("n_e")), "protected")
    terms = F.array_distinct(F.transform("near", lambda h: h.bitwiseAND(F.lit(-2))))  # a term may stand there in either way
    named = F.transform(terms, lambda t: F.struct(t.alias("term"), F.array_contains("near", t + 1).alias("name")))
    each = near.select("text_key", "entity", "rows", F.explode(named).alias("x")).select("text_key", "entity", "rows", "x.*")
    counted = each.groupBy("entity", "term").agg(F.sum("rows").alias("n_et"), F.count("*").alias("texts"), F.bool_or("name").alias("name"))
    pairs = written(counted, "pairs").join(entities, "entity")
    words = F.array_distinct(F.transform(words_of(text), lambda w: hashed(w, key)))
    terms = documents.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = float(max(documents.filter(text.isNotNull()).count(), 1))
    prior = F.when(F.col("name"), NAME).otherwise(WORD)
    likely = (F.col("texts") * F.col("n_et") / F.col("n_t") + STRENGTH * prior) / (F.col("texts") + STRENGTH)
    told = F.log(F.col("likely") * F.lit(total) / F.col("n_e"))
    information = F.log(F.lit(total) / F.col("n_e"))
    shrunk = pairs.join(terms, "term").withColumn("likely", likely).filter(F.col("likely") >= LEAST)
    found = shrunk.filter((information > 0) & (told >= DISCLOSURE * information)).select("entity", "term")
    marked = each.join(found, ["entity", "term"]).groupBy("text_key").agg(F.collect_set("term").alias("terms"))
    return written(marked, "terms")


def mark(documents: DataFrame) -> DataFrame:
    """Every input row with ``found`` (fixed spans) and ``terms`` (spans of disclosing terms)."""
    documents = documents.drop("found", "terms")
    key = uuid.uuid4().hex
    terms = disclosing(documents.select("text"), key).select(F.col("text_key").alias("_key"), F.col("terms").alias("_terms"))
    may = F.coalesce(F.col("text").rlike(NEEDED), F.lit(False))
    bare = documents.filter(~may).withColumn("found", S.none()).withColumn("terms", S.none())
    own = F.filter(
        F.array_distinct(words_of(F.col("text"))), lambda w: F.array_contains(F.col("_terms"), hashed(w, key))
    )
    pattern = _let(
        F.sort_array(own, asc=False),  # of two terms with one beginning, the longer is tried first
        lambda ws: F.when(F.size(ws) > 0, F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(ws, "|"), F.lit(r")(?!\p{L})"))),
    )
    rest = documents.filter(may).withColumn("_key", F.xxhash64("text")).join(terms, "_key", "left")
    rest = rest.withColumn("_pattern", F.when(F.col("_terms").isNotNull(), pattern)).withColumn("found", fixed(F.col("text")))
    places = F.when(F.col("_pattern").isNull(), S.none()).otherwise(S.matches(F.col("text"), F.col("_pattern"), 4, lambda v: F.lit(True)))
    return bare.unionByName(rest.withColumn("terms", places).drop("_key", "_terms", "_pattern"))


def redact(documents: DataFrame) -> DataFrame:
    """Every input row with its text's spans generalised to their kinds; n_chars follows. Null texts stay null."""
    spans = F.concat("found", "terms")
    aside = {c: f"_own_{c}" for c in ("found", "terms") if c in documents.columns}  # inputs of the spans' names
    marked = mark(documents.withColumnsRenamed(aside))
    done = marked.withColumn("text", S.replaced(F.col("text"), spans, TAGS)).drop("found", "terms")
    if "n_chars" in documents.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return done.withColumnsRenamed({b: a for a, b in aside.items()}).select(*documents.columns)


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("kind", "start")
    got = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id",
        *[S.count_of(F.col("found"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(S.joined(F.col("found"), KINDS, by), 256).alias("base_sha256"),
        S.joined(F.concat("found", "terms"), KINDS, by).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
