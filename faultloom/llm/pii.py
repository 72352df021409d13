"""PII surrogates [native]: detected entities get keyed, type-consistent replacements.

Detection is one regular expression over the whole text (secrets, access keys, emails, IBANs, card
numbers, phone numbers, US social security numbers, IPv4 addresses, names behind a title). A name that
is found behind a title is replaced wherever it stands in the same document with a capital letter, title
or not. Names that never follow a title in their document are not detected.

Each entity has a canonical form per kind - digits of a phone number, an email in lower case, one name
token - and each distinct canonical form gets one surrogate in the whole corpus, so that mentions that
belong together still do (coreference), in any layout.

Surrogates are made of a keyed SHA-256 stream: digits stay digits, letters keep case and alphabet;
cards keep issuer digit and a valid check digit, IBANs the country and valid check digits; phones keep
the country code; addresses get octets of 1 to 254; emails go to reserved example domains, equal domains
together; given names keep gender and script, family names script (and, in Cyrillic, the gendered ending).

Collision checks preserve distinctness: if two canonical forms of a kind get one surrogate, or a
surrogate is itself a canonical form that occurs, the later one draws again, until none is left. Names
have as many syllables as give ``ROOM`` surrogates for each form, and, as the local parts of emails, get
longer in later draws; where the format has a fixed length and is used up, an error is raised.

The key is a parameter, or else the session's setting ``spark.faultloom.pii.key``; where neither is set,
the session makes a random one, which is logged nowhere: surrogates agree within a session only.

Scale: texts are searched once; they and their entities become a table, with a number for each row.
Distinct forms and their checks are aggregations on the entities, which are narrow, and only texts that
have an entity take part in the join that replaces them. A form that occurs in a third of all texts is
one row of the table of forms; its mentions are the side of the join that adaptive execution splits.

Defined results: null and empty texts stay as they are, with 0 entities; equal texts get equal
results; an empty table gives an empty result; ``pseudonymize`` keeps other columns, but replaces an
input column ``n_entities``; its internal names start with ``_pii_``.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultloom.llm._common import written

#: Draws between two that make names and local parts of emails longer, and draws before a format counts as used up.
GROW_EVERY = 4
MAX_DRAWS = 40
#: Surrogates for each form of a name; a kind of at most FEW forms takes names of the list first.
ROOM = 64
FEW = 8
KEY_SETTING = "spark.faultloom.pii.key"

# Titles by gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа")
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин")
OTHER_TITLES = ("Dr", "Prof", "Mx")

# Given names that surrogates are drawn from, by gender and script.
GIVEN = {
    ("f", "latin"): ("Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula"),
    ("m", "latin"): ("Albert", "Bruno", "Conrad", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Konrad", "Leon", "Marcus", "Norbert", "Oscar", "Paul"),
    ("n", "latin"): ("Alex", "Billie", "Charlie", "Dana", "Eden", "Finley", "Gale", "Harper", "Indigo", "Jordan", "Kim", "Lee", "Morgan", "Noel", "Quinn", "Robin"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Мария", "Ольга"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Григорий", "Иван", "Максим", "Павел", "Сергей"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Шура", "Слава", "Паша", "Витя", "Тоня"),
}
# Syllables of names, and the endings that given names get after them.
SYLLABLES = {
    "latin": ("ba", "den", "fer", "gal", "hol", "jen", "kar", "lin", "mor", "nel", "pol", "ros", "sel", "tor", "ven", "wil"),
    "cyrillic": ("ба", "вол", "гар", "дем", "зар", "кор", "лин", "мор", "нев", "пол", "род", "сер", "тар", "фед", "хол", "шум"),
}
GIVEN_ENDINGS = {
    ("f", "latin"): "a", ("m", "latin"): "us", ("n", "latin"): "is", ("f", "cyrillic"): "а", ("m", "cyrillic"): "ин", ("n", "cyrillic"): "я",
}

_TITLE = "|".join(sorted((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
# A word of a name, hyphens and apostrophes inside included, but not a possessive ending.
_INSIDE = r"\p{L}*+(?:['’\-](?!s(?!\p{L}))\p{L}++)*+"
_NAME = rf"\p{{Lu}}{_INSIDE}"
_TOKEN = rf"\p{{L}}{_INSIDE}|[^\p{{L}}]++"
SECRET_HEAD = r"(?i:password|passwd|pwd|secret|token|api_?key)\s{0,8}[=:]\s{0,8}[\"']?"
#: kind -> pattern, in the order in which they are tried.
PATTERNS = {
    "secret": SECRET_HEAD + r"[A-Za-z0-9+/_\-]{8,}+",
    "key": r"AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![0-9])",
    "phone": (
        r"(?:\+?[0-9]{1,3}[ .\-]?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}"
        r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|\+[0-9]{1,3}(?:[ .\-][0-9]{2,4}){2,4}|\+[0-9]{9,14}"
        r"|[0-9]{3}([.\-])[0-9]{3}\1[0-9]{4})(?![0-9])"
    ),
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "ip": r"(?<![.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "name": rf"(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
}
ENTITY = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def _kind(entity: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("int")


def _stream(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """Hex digits of a keyed digest, two for each character of the canonical form and a few more."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(canon) + 40) / 32).cast("int"))
    # Key and text are length-prefixed parts of one message, so that no two messages read the same.
    message = F.concat_ws("\x1f", F.lit(f"{len(key)}:{key}"), kind, draw.cast("string"), canon)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", message, b.cast("string")), 256)), "")


def _at(stream: Column, i: Column) -> Column:
    return _hex_number(F.substr(stream, i * 2 + 1, F.lit(2)))


def _scramble(text: Column, stream: Column, hex_only: Column) -> Column:
    """Digits to digits, letters to letters of the same case (or hex digits to hex digits)."""
    turn = lambda c, i, first, n: F.char(F.pmod(F.ascii(c) - ord(first) + _at(stream, i), F.lit(n)) + ord(first))

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(hex_only & c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), F.pmod(_at(stream, i), F.lit(16)) + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), turn(c, i, "0", 10))
            .when(c.rlike("[a-z]"), turn(c, i, "a", 26))
            .when(c.rlike("[A-Z]"), turn(c, i, "A", 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(body: Column) -> Column:
    """The check digit for the digits before it."""
    doubled = F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    digits = F.transform(F.reverse(F.filter(F.split(body, ""), lambda c: c != "")), lambda c: c.cast("int"))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.get(doubled, d)).otherwise(d))
    return F.pmod(-F.aggregate(worth, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))))


def _check_digits(country: Column, body: Column) -> Column:
    """The two check digits of an IBAN: 98 less the rest by 97 of body, country and 00, letters as 10 to 35."""
    values = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    number = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55)
    rest = F.aggregate(values, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c), F.lit(97)))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _spoken(parts: tuple[str, ...], stream: Column, first: int, n: Column) -> Column:
    """n syllables."""
    return F.array_join(F.transform(F.sequence(F.lit(first), n.cast("int") + (first - 1)), lambda k: _pick(parts, _at(stream, k))), "")


def surrogate(kind: Column, canon: Column, draw: Column, key: str, n_forms: Column) -> Column:
    """The draw-th surrogate of a canonical form, of a kind that has n_forms forms."""
    s = _stream(key, kind, canon, draw)
    scrambled = _scramble(canon, s, (kind == "secret") & canon.rlike("^[0-9a-f]+$"))
    longer = F.floor(draw / GROW_EVERY)
    domain = F.concat(F.lit("mail"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(f"{len(key)}:{key}"), F.lit("domain"), F.substring_index(canon, "@", -1)), 256), 1, 10), F.lit(".example.org"))
    local = F.concat(F.when(longer > 0, _spoken(SYLLABLES["latin"], s, 30, longer)).otherwise(""), F.substring_index(scrambled, "@", 1))
    octets = F.concat_ws(".", *[(F.pmod(_hex_number(F.substr(s, F.lit(8 * k + 1), F.lit(4))), F.lit(254)) + 1).cast("string") for k in range(4)])
    card = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(scrambled, F.lit(2), F.length(canon) - 2))
    code = F.when(F.length(canon) > 10, F.length(canon) - 10).otherwise(0)  # country code
    country, account = F.substring(canon, 1, 2), F.substr(scrambled, F.lit(5), F.length(canon))
    made = (
        F.when(kind == "email", F.concat(local, F.lit("@"), domain))
        .when(kind == "ip", octets)
        .when(kind == "card", F.concat(card, _luhn(card)))
        .when(kind == "phone", F.concat(F.substr(canon, F.lit(1), code), F.substr(scrambled, code + 1, F.length(canon))))
        .when(kind == "key", F.concat(F.lit("AKIA"), F.substr(scrambled, F.lit(5), F.length(canon))))
        .when(kind == "iban", F.concat(country, _check_digits(country, account), account))
    )
    enough = F.ceil(F.log(n_forms * ROOM) / F.log(F.lit(16.0)))
    syllables = F.greatest(enough, F.lit(2)) + longer
    for (gender, script), names in GIVEN.items():
        listed = (n_forms <= FEW) & (draw < 2)
        spoken = F.initcap(F.concat(_spoken(SYLLABLES[script], s, 3, syllables), F.lit(GIVEN_ENDINGS[gender, script])))
        made = made.when(kind == f"given-{gender}-{script}", F.when(listed, _pick(names, _at(s, F.lit(0)))).otherwise(spoken))
    for script, parts in SYLLABLES.items():
        for gender, ending in (("f", "ова"), ("m", "ов"), ("n", "енко")) if script == "cyrillic" else (("", ""),):
            family = F.initcap(F.concat(_spoken(parts, s, 3, syllables + 1), F.lit(ending)))
            made = made.when(kind == (f"family-{gender}-{script}" if gender else f"family-{script}"), family)
    return made.otherwise(scrambled)


def _units(entity: Column) -> Column:
    """What is replaced of an entity: array of (kind, canon, head, shown); head stays before what is shown."""
    kind = _kind(entity)
    head = F.regexp_extract(entity, f"^({SECRET_HEAD})", 1)
    plain = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    canon = (
        F.when(kind == "secret", F.substr(entity, F.length(head) + 1, F.length(entity)))
        .when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "phone", "ssn", "iban"), plain)
        .otherwise(entity)
    )
    single = F.array(
        F.struct(
            kind.alias("kind"),
            canon.alias("canon"),
            F.when(kind == "secret", head).otherwise("").alias("head"),
            F.when(kind == "secret", canon).otherwise(entity).alias("shown"),
        )
    )
    parts = F.split(entity, " ")
    title = F.regexp_replace(F.get(parts, F.lit(0)), r"\.$", "")
    gender = F.when(title.isin(*FEMALE_TITLES), "f").when(title.isin(*MALE_TITLES), "m").otherwise("n")
    last = F.size(parts) - 1

    def name(part: Column, i: Column) -> Column:
        script = F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        of_family = F.when(script == "cyrillic", F.concat(F.lit("family-"), gender, F.lit("-cyrillic"))).otherwise("family-latin")
        kind_of = F.when(i == last - 1, of_family).otherwise(F.concat(F.lit("given-"), gender, F.lit("-"), script))
        return F.struct(
            kind_of.alias("kind"),
            F.lower(part).alias("canon"),
            F.when(i == 0, F.concat(F.get(parts, F.lit(0)), F.lit(" "))).otherwise(" ").alias("head"),
            part.alias("shown"),
        )

    return F.when(kind == "name", F.transform(F.slice(parts, 2, 2), name)).otherwise(single)


def _shown(kind: Column, shown: Column, made: Column) -> Column:
    """The surrogate in the layout of the mention."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    laid = F.aggregate(
        F.split(shown, ""),
        start,
        lambda acc, c: F.when(
            c.rlike("[0-9A-Za-z]"),
            F.struct(F.concat(acc["out"], F.substr(made, acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))),
        lambda acc: F.concat(acc["out"], F.substr(made, acc["k"], F.length(made))),
    )
    capitals = (F.upper(shown) == shown) & (F.length(shown) > 1) & (kind.startswith("family") | kind.startswith("given") | (kind == "email"))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), laid).when(capitals & shown.rlike(r"\p{L}"), F.upper(made)).otherwise(made)


def resolve(forms: DataFrame, key: str) -> DataFrame:
    """(kind, canon) -> with made, the surrogate: distinct within a kind, and none that is a form itself.

    A form keeps what it has once drawn without a collision; among those that collide, earlier draws
    come first, then the smaller form. Rounds end when nobody draws again.
    """
    sizes = F.broadcast(forms.groupBy("kind").agg(F.count(F.lit(1)).alias("n_forms")))  # kinds are a fixed few
    state = forms.join(sizes, "kind").select("kind", "canon", "n_forms", F.lit(0).alias("draw"))
    taken = forms.select("kind", F.col("canon").alias("made"), F.lit(True).alias("occurs"))
    for _ in range(MAX_DRAWS):
        drawn = state.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("draw"), key, F.col("n_forms")))
        same = Window.partitionBy("kind", F.lower("made")).orderBy("draw", "canon")
        drawn = drawn.withColumn("place", F.row_number().over(same))
        drawn = drawn.withColumn("form", F.when(F.col("kind").rlike("^(given|family|email)"), F.lower("made")).otherwise(F.col("made")))
        drawn = drawn.join(taken.withColumnRenamed("made", "form"), ["kind", "form"], "left").drop("form")
        drawn = written(drawn.withColumn("again", (F.col("place") > 1) | F.coalesce("occurs", F.lit(False))), "surrogates")
        if drawn.filter("again").isEmpty():
            return drawn.select("kind", "canon", "made")
        state = drawn.select("kind", "canon", "n_forms", (F.col("draw") + F.col("again").cast("int")).alias("draw"))
    full = [r.kind for r in drawn.filter("again").select("kind").distinct().collect()]
    raise RuntimeError(f"no free surrogates after {MAX_DRAWS} draws for {', '.join(sorted(full))}")


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting; a random one, kept for the session, where it is unset."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """The rows with surrogates in the text, and n_entities (long): mentions replaced."""
    key = key or session_key(docs.sparkSession)
    docs = docs.drop("n_entities")
    text = F.col(text_col)
    found = F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))
    base = written(docs.withColumn("_pii_found", found).withColumn("_pii_row", F.monotonically_increasing_id()), "searched")

    has = F.size("_pii_found") > 0
    entities = base.filter(has).select(F.col("_pii_row").alias("row"), F.posexplode("_pii_found").alias("at", "entity"))
    units = entities.select("row", "at", F.posexplode(_units(F.col("entity"))).alias("sub", "u")).select("row", "at", "sub", "u.*")
    units = written(units, "entities")
    names = resolve(units.select("kind", "canon").distinct(), key)
    named = units.join(names, ["kind", "canon"])
    put = F.concat("head", _shown(F.col("kind"), F.col("shown"), F.col("made")))
    puts = named.groupBy("row", "at").agg(F.array_sort(F.collect_list(F.struct("sub", put.alias("put")))).alias("p"))
    puts = puts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.array_join(F.transform("p", lambda x: x["put"]), "").alias("put")))).alias("_pii_put"))
    # A token that is a family name in one mention and a given name in another counts as the former.
    known = named.filter(F.col("kind").rlike("^(given|family)")).groupBy("row", "canon").agg(F.min_by("made", "kind").alias("made"))
    known = known.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("canon", "made"))).alias("_pii_names"))
    replaced = written(puts.join(known, "row", "left").withColumnRenamed("row", "_pii_row"), "replaced")

    def token(t: Column) -> Column:
        made = F.try_element_at("_pii_names", F.lower(t))
        hit = made.isNotNull() & t.rlike(r"^\p{Lu}")
        return F.struct(F.when(hit, _shown(F.lit("family"), t, made)).otherwise(t).alias("t"), hit.alias("hit"))

    same = base.filter(~has).withColumn("n_entities", F.lit(0).cast("long"))
    other = base.filter(has).join(replaced, "_pii_row").withColumn("_pii_rest", F.split(text, ENTITY, -1))
    tokens = lambda rest: F.regexp_extract_all(rest, F.lit(_TOKEN), F.lit(0))
    rest = F.when(F.col("_pii_names").isNull(), F.transform("_pii_rest", lambda r: F.array(F.struct(r.alias("t"), F.lit(False).alias("hit")))))
    other = other.withColumn("_pii_rest", rest.otherwise(F.transform("_pii_rest", lambda r: F.transform(tokens(r), token))))
    mentions = F.aggregate("_pii_rest", F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda x: x["hit"])))
    whole = F.transform(
        "_pii_rest",
        lambda r, i: F.concat(F.array_join(F.transform(r, lambda x: x["t"]), ""), F.coalesce(F.get("_pii_put", i)["put"], F.lit(""))),
    )
    other = other.withColumn("n_entities", (F.size("_pii_found") + mentions).cast("long")).withColumn(text_col, F.array_join(whole, ""))
    return reduce(DataFrame.unionByName, [x.select(*docs.columns, "n_entities") for x in (same, other)])
