"""Personal data replaced by keyed surrogates of the same type, gender, script and format. DataFrame functions only.

Detected are mail addresses, telephone numbers, payment card numbers, IPv4 addresses, names after a title, and the words of
such names wherever else the same document has them. What an
entity's surrogate is depends only on the key and the entity in canonical form, so all mentions of one entity, in any
document and spelling, get one surrogate. Whether two entities share a surrogate, or a surrogate is itself a real entity
of the corpus, is checked over the table of distinct entities; losers draw again, names with one syllable more each time.
After MAX_DRAWS draws, losers of a fixed format get its free values in order; mail addresses and telephone numbers of a
format without free values become longer, so any number of entities is settled. Only those that drew again are looked up
when texts are rewritten, so without many collisions no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_dealt, materialize
from .secrets import let, running

# What is detected, most specific first. All repetitions of groups are bounded (those of a mail address as its
# standards have it), since Java matches them by recursion; no pattern looks far from where it begins.
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"
CARD = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9])"
_END = r"(?![0-9]|[ .-][0-9]{2,4}(?![0-9]))"
PHONE = "|".join(
    (
        r"\+[0-9]{10,15}(?![0-9])",
        r"\+[0-9]{1,3}[ .-]?\([0-9]{1,5}\)(?:[ .-]?[0-9]){4,13}" + _END,
        r"\+(?=[0-9]{1,3}[ .-]?[0-9]?[ .-]?[0-9]{2})[0-9](?:[ .-]?[0-9]){6,14}" + _END,
        r"(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])",
        r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
        r"(?<![0-9][ .-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9]|[ .-][0-9])",
    )
)
MALE = ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
NAME = r"(?:" + "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True)) + r")\.? \p{Lu}\p{Ll}{1,63}+(?: \p{Lu}\p{Ll}{1,63}+)?"
# A word that may be one of a name's, wherever the document has it.
WORD = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{1,63}+(?![\p{L}\p{N}])"
KINDS = {"email": EMAIL, "ip": IPV4, "card": CARD, "phone": PHONE, "name": NAME}
# An entity begins where no letter or digit precedes; nothing is tried elsewhere.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
# Country codes in use; which digits of an international number are its country's follows from the digits alone.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[035789][0-9]|9[679][0-9]"
# Letters and syllables from which surrogates are built, by script; names of men and women end differently.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {
    "latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so",
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со",
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο",
}
ENDINGS = {
    "latin": {"any": "l", "male": "n", "female": "nna", "sur": "rt"},
    "cyrillic": {"any": "л", "male": "н", "female": "нна", "sur": "рт"},
    "greek": {"any": "λ", "male": "ς", "female": "ννα", "sur": "ρτης"},
}
MAX_DRAWS = 16  # after so many draws, what has a fixed format gets the free values of its format in order
SEP = "\u0001"
FORMAT = ["kind", "head", "body", "tail"]
BLOCK = 4096
SENT = 100_000  # so many entries of later draws at most are sent to every executor; for more, texts with entities are shuffled


def kind_of(entity: Column) -> Column:
    out = F.when(entity.contains("@"), "email").when(entity.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip").when(entity.rlike(f"^(?:{CARD})$"), "card")
    return out.when(entity.rlike("^[+(0-9]"), "phone").otherwise("name")


def parts_of(entity: Column, kinds: Column | None = None) -> Column:
    """array<struct<kind, canon>> of what gets a surrogate of its own: the entity itself, or each word of a name. A word
    that stands alone after its title is a surname; the first of two is a given name of the title's gender. After a title of
    no gender, a given name has the gender that kinds has for it (those of the word asked_of the entity among the document's
    titled names), or else none ("given:any"). A telephone number's country code stands apart, as "+1 4155550123"; its
    surrogate keeps it. A word without a title is what kinds has it as, a surname before a given name."""
    plain = F.struct(kind_of(entity).alias("kind"), F.when(entity.contains("@"), F.lower(entity)).otherwise(F.regexp_replace(entity, r"[^0-9.]|(?<![0-9])\.|\.(?![0-9])", "")).alias("canon"))
    digits = F.regexp_replace(entity, "[^0-9]", "")
    digits = F.struct(kind_of(entity).alias("kind"), F.when(entity.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(digits, f"^({COUNTRY}|)", "$1 "))).otherwise(digits).alias("canon"))

    def name(words: Column) -> Column:
        title = F.rtrim(F.element_at(words, 1), F.lit("."))
        gender = F.when(title.isin(*FEMALE), "given:female").when(title.isin(*MALE), "given:male")
        if kinds is not None:
            gender = F.coalesce(gender, F.array_max(F.filter(kinds, lambda k: k.startswith("given:"))))
        given = F.struct(F.coalesce(gender, F.lit("given:any")).alias("kind"), F.lower(F.element_at(words, 2)).alias("canon"))
        last = F.struct(F.lit("surname").alias("kind"), F.lower(F.element_at(words, -1)).alias("canon"))
        return F.when(F.size(words) > 2, F.array(given, last)).otherwise(F.array(last))

    kind = kind_of(entity)
    titled = let(F.split(entity, " "), name)
    if kinds is not None:
        titled = F.when(entity.contains(" "), titled).otherwise(F.array(F.struct(F.array_max(kinds).alias("kind"), F.lower(entity).alias("canon"))))
    return F.when(kind == "name", titled).when(kind.isin("card", "phone"), F.array(digits)).otherwise(F.array(plain))


def names_of(found: Column) -> Column:
    """Words of the titled names among the entities found, each with what it is, in order: what kinds_of looks them up in."""
    parts = F.flatten(F.transform(F.filter(found, lambda e: kind_of(e) == "name"), lambda e: parts_of(e)))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.concat(p["canon"], F.lit(SEP), p["kind"]))))


def kinds_of(names: Column, canon: Column) -> Column:
    """What a word is among names, in order: found by halving, so a text's names cost hardly more for being many."""
    sought = F.concat(canon, F.lit(SEP))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        right = F.struct((middle + 1).alias("low"), acc["high"].alias("high"))
        left = F.struct(acc["low"].alias("low"), middle.alias("high"))
        return F.when(acc["low"] >= acc["high"], acc).when(F.get(names, middle) < sought, right).otherwise(left)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(names) + 1)).cast("int"))
    first = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(names).alias("high")), halve, lambda acc: acc["low"])
    near = F.slice(names, first + 1, F.lit(4))  # there are four kinds of words
    return F.transform(F.filter(near, lambda n: n.startswith(sought)), lambda n: F.substring_index(n, SEP, -1))


def is_bare(entity: Column) -> Column:
    """A word that no title precedes."""
    return (kind_of(entity) == "name") & ~entity.contains(" ")


def asked_of(entity: Column) -> Column:
    """The word of an entity that the document's titled names decide about: one without a title, or the given name after a
    title of no gender; null where they decide nothing."""
    neutral = entity.rlike(r"^(?:" + "|".join(NEUTRAL) + r")\.? \S+ \S")
    return F.when(is_bare(entity), F.lower(entity)).when(neutral, F.lower(F.element_at(F.split(entity, " "), 2)))


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def drawn(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """64 numbers from 0 to 65,535 that only the key's holder can tell from random ones."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canon, draw.cast("string"))
    hexed = F.concat(F.sha2(F.concat(seed, F.lit("/0")), 512), F.sha2(F.concat(seed, F.lit("/1")), 512))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def like(text: Column, numbers: Column) -> Column:
    """Each digit becomes a digit, each letter a letter of its script; the rest stays."""
    alphabet = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k, v)])
    script = script_of(text)

    def one(c: Column, i: Column) -> Column:
        v = F.element_at(numbers, (i % 64 + 1).cast("int"))
        letters = F.element_at(alphabet, script)
        letter = F.substring(letters, v % F.length(letters) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(chars(text), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the last but one on doubled (its digits added)."""
    n = F.size(digits)
    value = lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda acc, v: acc + v)


def closed(body: Column, off: Column) -> Column:
    """With a last digit that is `off` from the check digit."""
    return let(body, lambda b: F.concat(b, ((10 - luhn_sum(chars(F.concat(b, F.lit("0")))) % 10 + off) % 10).cast("string")))


def card_like(canon: Column, numbers: Column) -> Column:
    """As many digits, with a valid check digit exactly if the original has one."""
    body = like(F.substring(canon, F.lit(1), F.length(canon) - 1), numbers)
    return closed(body, F.when(luhn_sum(chars(canon)) % 10 == 0, 0).otherwise(1 + F.element_at(numbers, 64) % 9))


def country_of(canon: Column) -> Column:
    return F.regexp_extract(canon, r"^\+[0-9]* ", 0)


def domain_of(canon: Column) -> Column:
    return F.regexp_extract(canon, r"\.[a-z]{2,}$", 0)


def surrogate(key: str, kind: Column, canon: Column, draw: int) -> Column:
    """The surrogate of a part in canonical form. Names grow by a syllable with each draw, mail addresses by a letter and
    telephone numbers by a digit with each draw after MAX_DRAWS."""
    longer = max(0, draw - MAX_DRAWS)

    def make(numbers: Column) -> Column:
        octets = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(1, 5)]), lambda i: (1 + F.element_at(numbers, i) % 254).cast("string")), ".")
        more = F.slice(F.reverse(numbers), 1, longer)
        letters = F.array_join(F.transform(more, lambda v: F.substring(F.lit(LETTERS["latin"]), v % 26 + 1, F.lit(1))), "")
        domain = domain_of(canon)
        mail = F.concat(letters, like(F.substring(canon, F.lit(1), F.length(canon) - F.length(domain)), numbers), domain)
        script = script_of(canon)
        pick = lambda table: F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), script)
        syllable = lambda v: F.element_at(F.split(pick(SYLLABLES), " "), (v % 32 + 1).cast("int"))
        ending = pick({k: v["sur"] for k, v in ENDINGS.items()})
        for gender in ("any", "male", "female"):
            ending = F.when(kind == f"given:{gender}", pick({k: v[gender] for k, v in ENDINGS.items()})).otherwise(ending)
        name = F.concat(F.array_join(F.transform(F.slice(numbers, 1, 3 + draw), syllable), ""), ending)
        country = country_of(canon)
        digits = F.array_join(F.transform(more, lambda v: (v % 10).cast("string")), "")
        phone = F.concat(country, like(F.substring(canon, F.length(country) + 1, F.length(canon)), numbers), digits)
        return F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "card", card_like(canon, numbers)).when(kind == "phone", phone).otherwise(name)

    return let(drawn(key, kind, canon, F.lit(draw)), make)


def poured(template: Column, content: Column) -> Column:
    """content's digits in the places of template's digits, those beyond them at the end."""

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substring(content, before, F.lit(1))).otherwise(c)

    places = F.length(F.regexp_replace(template, "[^0-9]", ""))
    return F.concat(F.array_join(F.transform(chars(template), one), ""), F.substring(content, places + 1, F.length(content)))


def cased(template: Column, content: Column) -> Column:
    """Upper case where a mail address has it; of a longer content, at its end."""

    def over(more: Column) -> Column:
        rest = F.substring(content, more + 1, F.length(content))
        return F.concat(F.substring(content, F.lit(1), more), F.array_join(F.zip_with(chars(template), chars(rest), lambda a, b: F.when(a.rlike(r"\p{Lu}"), F.upper(b)).otherwise(b)), ""))

    return let(F.length(content) - F.length(template), over)


def rewritten(key: str, entity: Column, kinds: Column, again: Column | None) -> Column:
    """An entity's mention with its surrogate, in the mention's own format; again has surrogates that are no first draws."""

    def settled(p: Column) -> Column:
        first = surrogate(key, p["kind"], p["canon"], 0)
        return first if again is None else F.coalesce(F.element_at(again, F.concat_ws("\u0001", p["kind"], p["canon"])), first)

    def fill(made: Column) -> Column:
        first = F.element_at(made, 1)
        kind = kind_of(entity)
        phone = poured(entity, F.regexp_replace(first, "[^0-9]", ""))
        name = F.concat(F.regexp_extract(entity, r"^(?:\S+ )?", 0), F.array_join(F.transform(made, lambda m: F.concat(F.upper(F.substring(m, 1, 1)), F.substring(m, F.lit(2), F.length(m)))), " "))
        return F.when(kind == "email", cased(entity, first)).when(kind == "ip", first).when(kind == "card", poured(entity, first)).when(kind == "phone", phone).otherwise(name)

    return let(F.transform(parts_of(entity, kinds), settled), fill)


def base_of(c: Column, letters: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).when(c.rlike(r"\p{L}"), F.length(letters)).otherwise(1)


def letters_of(body: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k, v)]), script_of(body))


def nth_value(n: Column) -> Column:
    """The n-th value of the format in head, body and tail: the body's places count like those of a number."""
    kind, head, body, tail = (F.col(c) for c in FORMAT)

    def step(acc: Column, c: Column) -> Column:
        base = base_of(c, letters_of(body))
        v = acc["rest"] % base
        symbol = F.when(c.rlike("[0-9]"), v.cast("string")).when(c.rlike(r"\p{L}"), F.substring(letters_of(body), (v + 1).cast("int"), F.lit(1))).otherwise(c)
        return F.struct(F.floor(acc["rest"] / base).cast("long").alias("rest"), F.concat(symbol, acc["out"]).alias("out"))

    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("out"))
    filled = F.aggregate(F.reverse(chars(body)), start, step, lambda acc: acc["out"])
    octets = F.concat_ws(".", *[(1 + F.floor(n / 254**k) % 254).cast("string") for k in (3, 2, 1, 0)])
    return F.when(kind == "ip", octets).when(kind == "card", closed(filled, tail.cast("int"))).otherwise(F.concat(head, filled, tail))


def with_format(parts: DataFrame) -> DataFrame:
    """The parts whose surrogates keep a format, with it: head and tail stay (a card's tail says whether it is valid)."""
    kind, canon = F.col("kind"), F.col("canon")
    head = F.when(kind == "phone", country_of(canon)).otherwise("")
    tail = F.when(kind == "email", domain_of(canon)).when(kind == "card", F.when(luhn_sum(chars(canon)) % 10 == 0, "0").otherwise("1")).otherwise("")
    rows = parts.where(kind.isin("email", "phone", "card", "ip")).withColumn("head", head).withColumn("tail", tail)
    cut = F.when(kind == "card", 1).otherwise(F.length("tail"))
    plain = F.regexp_replace(F.substring(canon, F.length("head") + 1, F.length(canon) - F.length("head") - cut), "[0-9]", "0")
    return rows.withColumn("body", F.when(kind == "ip", "").otherwise(F.regexp_replace(plain, r"\p{L}", F.substring(letters_of(plain), 1, 1))))


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """rows with nth, from 0 on within each format. Each format is numbered in 256 parts, so no task gets all of one."""
    rows = rows.withColumn("order", order).withColumn("part", F.pmod(F.xxhash64("order"), F.lit(256)))
    before = F.sum("count").over(Window.partitionBy(*FORMAT).orderBy("part")) - F.col("count")
    parts = rows.groupBy(*FORMAT, "part").count().withColumn("before", before).drop("count")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*FORMAT, "part").orderBy("order")) - 1)
    return rows.join(parts, [*FORMAT, "part"]).withColumn("nth", F.col("before") + F.col("at")).drop("order", "part", "at", "before")


def in_order(key: str, pending: DataFrame, settled: DataFrame, originals: DataFrame) -> DataFrame:
    """kind, canon, draw, surrogate of pending: values of the part's format that are neither surrogates nor originals; null
    where no such value is left, and for names. Among as many values as there are losers and values in use, enough are
    free, so no more are looked at."""
    losers = numbered(with_format(pending), F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon"), 256))
    used = originals.unionByName(settled.select("kind", F.col("surrogate").alias("canon"))).distinct()
    forms = F.when(F.col("kind") == "ip", 254.0**4).otherwise(F.aggregate(chars(F.col("body")), F.lit(1.0), lambda acc, c: acc * base_of(c, letters_of(F.col("body")))))
    wanted = losers.select(*FORMAT).unionByName(with_format(used).select(*FORMAT)).groupBy(*FORMAT).agg(F.count(F.lit(1)).alias("n"))
    wanted = wanted.join(losers.select(*FORMAT).distinct(), FORMAT, "left_semi").withColumn("n", F.least(F.col("n").cast("double"), forms).cast("long"))
    blocks = wanted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))).repartition(*FORMAT, "block")
    values = blocks.withColumn("v", F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1)))
    values = values.select(*FORMAT, nth_value(F.col("v")).alias("surrogate"))
    free = numbered(values.join(used.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti"), F.col("surrogate"))
    given = losers.join(free, [*FORMAT, "nth"], "left").select("kind", "canon", "surrogate")
    names = pending.where("kind not in ('email', 'phone', 'card', 'ip')").withColumn("surrogate", F.lit(None).cast("string"))
    return given.unionByName(names).select("kind", "canon", F.lit(MAX_DRAWS).alias("draw"), "surrogate")


def entity_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """kind, canon, draw, surrogate of the corpus's distinct parts; surrogates are distinct within a kind and no originals.

    A part loses a draw if its surrogate is some part's original, or a smaller part of the kind has it. Draws repeat for
    the losers alone; after MAX_DRAWS of them, values are given out in order (see in_order), and what gets none draws on
    with longer surrogates. Only more cards or IPv4 addresses than there are at all raise an error."""
    spark = docs.sparkSession
    # Surrogates cost time, not bytes, so a table that is small in bytes must not end up in one task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    mentions = docs.where(F.col(text).rlike(ANY)).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).alias("entity")).distinct()
    originals = materialize(mentions.select(F.explode(parts_of(F.col("entity"))).alias("p")).select("p.*").distinct(), "entities")
    pending, settled = originals, None
    draw = 0
    while True:
        made = pending.repartition(tasks, "kind", "canon").withColumn("draw", F.lit(draw)).withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), draw))
        made = materialize(made, "made")
        everything = made if settled is None else made.unionByName(settled)
        # Settled parts win over pending ones, then the smallest part does.
        owner = everything.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "canon")).alias("owner"))
        real = originals.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        judged = everything.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        good = F.col("real").isNull() & (F.col("owner.canon") == F.col("canon"))
        table = materialize(judged.select("kind", "canon", "draw", "surrogate", good.alias("good")), "draws")
        settled = table.where("good").drop("good")
        pending = table.where("not good").select("kind", "canon")
        draw += 1
        if draw == MAX_DRAWS and not pending.isEmpty():
            given = materialize(in_order(key, pending, settled, originals), "in-order")
            settled = settled.unionByName(given.where("surrogate is not null"))
            pending = given.where("surrogate is null").select("kind", "canon")
            draw += 1
            if not pending.where("kind in ('card', 'ip')").isEmpty():
                raise ValueError("there are more cards or addresses than their format can hold")
        if pending.isEmpty():
            return settled


def pseudonymise(docs: DataFrame, key: str, text: str = "text", doc_key: str = "doc_id") -> DataFrame:
    """One row per document: key, text with surrogates, entities (kind, start and end in the original text), n_entities.

    The telephone country code, a mail address's top-level domain, separators and case stay. Null texts stay null and
    have no entities. Texts of any length are taken whole; their cost grows with their length and the entities in them.
    Equal entities get equal surrogates wherever they are; rows may repeat; an empty table gives an empty result; other
    columns are ignored. The key is part of the query plan: whoever may read plans and event logs can undo a surrogate.
    """
    table = entity_table(docs, key, text)
    rows = docs.select(docs[doc_key].alias("doc_id"), docs[text].alias("text"))
    again = table.where("draw > 0")
    lookups = None
    if not again.isEmpty():
        entry = F.concat_ws("\u0001", "kind", "canon")
        has = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
        with_entities = rows.where(has).withColumn("sha", F.sha2("text", 256))
        # Every reading of a mention that the document's other names may decide.
        readings = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda e: parts_of(e)))
        held = with_entities.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.first(readings).alias("p")).select("sha", "copies", F.explode("p").alias("p")).select("sha", "copies", "p.*").distinct()
        lookup = held.join(again.select("kind", "canon", "surrogate"), ["kind", "canon"]).groupBy("sha", "copies").agg(F.map_from_entries(F.collect_list(F.struct(entry, "surrogate"))).alias("again"))
        lookup = materialize(lookup, "lookup")
        entries, copies = lookup.agg(F.coalesce(F.sum(F.size("again")), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
        if entries <= SENT:
            rows = rows.withColumn("sha", F.sha2("text", 256)).join(F.broadcast(lookup.drop("copies")), "sha", "left").drop("sha")
        else:
            found = join_dealt(with_entities, lookup.drop("copies"), "sha", hot_keys(lookup, "sha", "copies", copies), ["doc_id"], "left").drop("sha")
            rows = found.unionByName(rows.where(~has), allowMissingColumns=True)
        lookups = F.coalesce("again", F.create_map().cast("map<string,string>"))
    t = F.col("text")
    rows = rows.withColumn("names", F.when(t.rlike(ANY), names_of(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))))
    # Only where a document has titled names are its other words looked up.
    pattern = F.when(F.size("names") > 0, ANY + "|" + WORD).otherwise(ANY)
    unasked = F.array().cast("array<string>")
    asked = lambda e: let(asked_of(e), lambda word: F.when(word.isNotNull(), kinds_of(F.col("names"), word)).otherwise(unasked))
    seen = F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), lambda e: F.struct(e.alias("entity"), asked(e).alias("kinds")))
    seen = F.transform(seen, lambda m: F.struct(m["entity"].alias("entity"), m["kinds"].alias("kinds"), (~is_bare(m["entity"]) | (F.size(m["kinds"]) > 0)).alias("real")))
    rows = rows.withColumn("seen", F.when(F.col("names").isNotNull(), seen))
    seen, gaps = F.col("seen"), F.split(t, pattern, -1)
    written = F.transform(seen, lambda m: F.when(m["real"], rewritten(key, m["entity"], m["kinds"], lookups)).otherwise(m["entity"]))
    new = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(seen)), written, lambda g, e: F.concat(g, e)), ""), F.element_at(gaps, -1))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    gap_sizes = F.slice(F.transform(gaps, lambda g: F.length(g)), F.lit(1), F.size(seen))
    ends = running(F.zip_with(gap_sizes, seen, lambda g, m: (g + F.length(m["entity"])).cast("bigint")))
    span = lambda m, end: F.when(m["real"], F.struct(kind_of(m["entity"]).alias("kind"), (end - F.length(m["entity"])).cast("int").alias("start"), end.cast("int").alias("end")))
    placed = F.filter(F.zip_with(seen, ends, span), lambda p: p.isNotNull())
    has = F.col("names").isNotNull()
    rows = rows.select("doc_id", F.when(has, new).otherwise(t).alias("text"), F.when(has, placed).otherwise(none).alias("entities"))
    return rows.select("doc_id", "text", "entities", F.size("entities").cast("long").alias("n_entities"))
