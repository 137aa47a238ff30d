"""PII surrogates: every detected entity gets a keyed replacement of its own type, in DataFrame functions only.

* Detection: one ordered pattern for e-mail addresses, hexadecimal secrets, IPv4 and IPv6 addresses, IBANs, payment cards,
  national ids, phone numbers and names of persons.  Names are found by a title or a listed given name.
* An entity's canonical form (digits of a phone number, lower-case e-mail address, one word of a name, ...) gets its
  surrogate, so all its mentions in all documents get the same one, in each mention's own format.
* The surrogate comes from a keyed digest.  Names keep script, gender and case; numbers keep their length and
  punctuation, cards and IBANs a valid check, phone numbers their country code or first 0, e-mail addresses the
  pattern of their local part.
* Collision checks: two entities of a type never share a surrogate, and a surrogate is never itself an entity of the
  data.  Those that collide take the next digest until none does.

Only texts with an entity are taken apart; only entities are shuffled, with their documents' row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Titles by gender, and given names that show a person without a title.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Doña", "Госпожа", "г-жа"],
          "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н"],
          "n": ["Dr", "Prof", "Doctor", "Professor"]}
GIVEN = {"f": ["Mary", "Patricia", "Jennifer", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Maria", "Ursula",
               "Sabine", "Claudia", "Isabelle", "Nathalie", "Sophie", "Carmen", "Lucía", "Ольга", "Елена", "Наталья", "Анна", "Мария"],
         "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Hans",
               "Klaus", "Jürgen", "Wolfgang", "Pierre", "François", "Jacques", "José", "Carlos", "Javier", "Иван", "Сергей",
               "Дмитрий", "Алексей", "Николай"]}
# 16 syllables per script, one for each hexadecimal digit.
LATIN = ["ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "zo", "ka", "le"]
CYRILLIC = ["ба", "ве", "ди", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "зо", "ка", "ле"]

_NAME = r"\p{Lu}(?:[\p{Ll}'’]+|\p{Lu}{2,})(?:-\p{Lu}\p{Ll}+)?"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_LISTED = "|".join(n for g in GIVEN.values() for n in g)
_EDGE = r"(?<![\p{L}\p{N}_])"
TYPES = [  # in order of priority
    # Local part, label and number of labels have the lengths that the format allows; the repeats give nothing back,
    # so a match takes time in proportion to the text and a fixed depth of the matcher's stack.
    ("email", r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|gh[pousr])[-_][0-9A-Za-z]{20,64})(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,40}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
             r"|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![0-9A-Za-z:])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z+])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+(?!1)\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}"
              r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
              # national forms with spaces: 212 555 0187; 01 23 45 67 89; 030 12345678; 612 345 678; 912 34 56 78
              r"|(?<![.,-])(?:\d{3} \d{3} \d{4}|0[1-9](?:[ .-]\d{2}){4}|0[1-9]\d{1,3}[ /-]\d{5,8}|[6-9]\d{2}(?: \d{3}){2}|[89]\d{2}(?: \d{2}){3})(?![ .-]\d))"
              r"(?![0-9A-Za-z])"),
    ("name", rf"{_EDGE}(?:(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_LISTED}) {_NAME})(?![\p{{L}}\p{{N}}])"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in TYPES)
MAX_ROUNDS = 64  # of collision checks: a form whose replacements are used up is an error, not an endless loop
HINT = rf"[0-9@]|{_EDGE}(?:{_TITLE}|{_LISTED})\.? \p{{Lu}}"


def digest(key: str, kind: Column, canon: Column, salt: Column) -> Column:
    """64 hexadecimal digits: sha256 of the key and the sha256 of the key and the message."""
    message = F.concat_ws("|", kind, canon, salt.cast("string"))
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), message), 256)), 256)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def type_of(surface: Column) -> Column:
    """The first type whose pattern gives the whole match; what stood around it is not seen here."""
    kind = F.lit("name")
    for name, pattern in reversed(TYPES[:-1]):
        kind = F.when(surface.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(kind)
    return kind


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check; the last digit counts once, the one before it doubled, and so on."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    turned = F.reverse(digits)

    def value(i):
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda total, i: total + F.coalesce(value(i), F.lit(0)))


def mod97(text: Column) -> Column:
    """Remainder by 97 of digits and letters, where A is 10 and Z is 35."""
    def add(total, i):
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), F.lit(0), lambda t, i: F.coalesce(add(t, i), t))


def canonical(kind: Column, surface: Column) -> Column:
    return (F.when(kind.isin("card", "phone", "ssn"), F.concat(digits_only(surface), F.when(surface.startswith("+"), "+").otherwise("")))
            .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
            .when(kind == "secret", surface)
            .otherwise(F.lower(surface)))


def _syllables(hexes: Column, n: Column, table: list[str]) -> Column:
    picks = F.array(*[F.lit(s) for s in table])
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(
        picks, F.conv(F.substring(hexes, i, F.lit(1)), 16, 10).cast("int") + 1)), "")


def surrogate(key: str, kind: Column, canon: Column, salt: Column) -> Column:
    """Canonical surrogate of a canonical entity.  ``kind`` of a name's word: given_f, given_m, given_n, surname,
    or surname_f, surname_m, surname_n where it has a gender."""
    hexes = digest(key, kind, canon, salt)
    long = F.concat(hexes, digest(key, F.concat(kind, F.lit("2")), canon, salt))
    digits = F.translate(long, "abcdef", "072583")
    number = digits_only(canon)
    size = F.length(number)
    # Cards: first digit kept; the last one makes the sum valid where it was.
    body = F.concat(F.substring(number, 1, 1), F.substring(digits, F.lit(1), size - 2))
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    same = F.substring(digits, F.lit(100), F.lit(1))
    card = F.concat(body, F.when(luhn_sum(number) % 10 == 0, check).otherwise(same))
    # Phones: the digits of the country code stay (one for +1 and +7, else two); no digit group starts with 0.
    # A national number keeps its first 0.
    code = F.when(~canon.endswith("+"), F.when(canon.startswith("0"), 1).otherwise(0)).when(F.substring(number, 1, 1).isin("1", "7"), 1).otherwise(2)
    first = F.translate(F.substring(digits, 1, 1), "01", "98")
    phone = F.concat(F.substring(number, F.lit(1), code), first, F.substring(digits, F.lit(2), size - code - 1),
                     F.when(canon.endswith("+"), "+").otherwise(""))
    octet = [F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("int") for i in range(4)]
    ip = F.concat_ws(".", (F.pmod(octet[0], F.lit(223)) + 1).cast("string"), *[o.cast("string") for o in octet[1:]])

    def refill(text: Column, start: int) -> Column:
        """Letters for letters, digits for digits; other characters stay."""
        def one(i):
            c, h = F.substring(text, i, F.lit(1)), F.conv(F.substring(long, F.pmod(i + start, F.lit(128)) + 1, F.lit(1)), 16, 10).cast("int")
            more = F.conv(F.substring(long, F.pmod(i * 7 + start + 31, F.lit(128)) + 1, F.lit(1)), 16, 10).cast("int")
            letter = F.char(97 + F.pmod(h * 16 + more, F.lit(26)))
            return (F.when(c.rlike("[0-9]"), F.pmod(h * 16 + more, F.lit(10)).cast("string"))
                    .when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), "")

    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    email = F.concat(refill(local, 0), F.when(salt > 0, salt.cast("string")).otherwise(""), F.lit("@mail-"),
                     F.substring(digest(key, F.lit("domain"), domain, F.lit(0)), 1, 6), F.lit(".example.org"))
    secret = (F.when(canon.rlike(r"\A[0-9a-f]+\z"), F.substring(long, F.lit(1), F.length(canon)))
              .when(canon.rlike(r"\A[0-9A-F]+\z"), F.upper(F.substring(long, F.lit(1), F.length(canon))))
              .otherwise(F.concat(F.regexp_extract(canon, r"\A(AKIA|sk[-_]|gh[pousr][-_])", 1),
                                  refill(F.regexp_replace(canon, r"\A(AKIA|sk[-_]|gh[pousr][-_])", ""), 5))))
    country, account = F.substring(canon, 1, 2), refill(F.substring(canon, F.lit(5), F.length(canon) - 4), 3)
    iban = F.concat(country, F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    ipv6 = F.concat(F.lit("fd"), F.substring(hexes, 1, 2), *[F.concat(F.lit(":"), F.substring(hexes, 4 * i, 4)) for i in range(1, 8)])
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    given, surname = F.lit(2) + salt.cast("int"), F.lit(3) + salt.cast("int")
    gender = F.substring(kind, -1, 1)
    # Letters that a Latin given name ends in: a for women, n for men; Cyrillic surnames agree in gender.
    name = (F.when(cyrillic & kind.startswith("given"), F.concat(_syllables(hexes, given, CYRILLIC), F.when(gender == "f", "на").otherwise("н")))
            .when(cyrillic, F.concat(_syllables(hexes, surname, CYRILLIC), F.when(gender == "f", "ва").otherwise("в")))
            .when(kind.startswith("given"), F.concat(_syllables(hexes, given, LATIN), F.when(gender == "f", "na").otherwise("n")))
            .otherwise(F.concat(_syllables(hexes, surname, LATIN), F.lit("r"))))
    return (F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "iban", iban)
            .when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", F.substring(digits, F.lit(1), size))
            .otherwise(name))


def in_format(kind: Column, surface: Column, replacement: Column) -> Column:
    """The canonical surrogate in the format of a mention: its punctuation, spaces and case."""
    number, plain = digits_only(replacement), F.replace(replacement, F.lit(" "), F.lit(""))

    def fill(pattern: str, source: Column) -> Column:
        def one(i):
            c = F.substring(surface, i, F.lit(1))
            before = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), pattern, ""))
            return F.when(c.rlike(pattern), c).otherwise(F.substring(source, before, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(surface), F.lit(1))), one), "")

    return (F.when(kind.isin("card", "phone", "ssn"), fill("[^0-9]", number))
            .when(kind == "iban", fill(" ", plain))
            .when(kind.rlike("^(given|surname)"), F.when(surface == F.upper(surface), F.upper(replacement)).otherwise(F.initcap(replacement)))
            .otherwise(replacement))


def _gender(title: Column, given: Column) -> Column:
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(title.isin(*TITLES[g]) | given.isin(*GIVEN[g]), F.lit(g)).otherwise(out)
    return out


def parts_of(kind: Column, surface: Column) -> Column:
    """Pieces of a mention: (text, kind); a null kind is kept as it is.  A name gives a piece for each word."""
    piece = "array<struct<text: string, kind: string>>"
    whole = F.array(F.struct(surface.alias("text"), kind.alias("kind"))).cast(piece)
    words = F.split(surface, " ")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    titled = title.isin(*[t for g in TITLES.values() for t in g])
    first = F.when(titled, 2).otherwise(1)
    gender = _gender(title, F.element_at(words, first))
    n = F.size(words)

    def one(i):
        kind = (F.when(i < first, F.lit(None).cast("string")).when((i == first) & (n > first), F.concat(F.lit("given_"), gender))
                # Only Cyrillic surnames agree in gender; others are the same for all who bear them.
                .otherwise(F.when(F.element_at(words, i).rlike(r"\p{IsCyrillic}"), F.concat(F.lit("surname_"), gender)).otherwise("surname")))
        return F.struct(F.concat(F.element_at(words, i), F.when(i < n, " ").otherwise("")).alias("text"), kind.alias("kind"))

    return F.when(kind == "name", F.transform(F.sequence(F.lit(1), n), one).cast(piece)).otherwise(whole)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate for distinct entities (kind, canon), without collisions.  Kinds that share a form of
    text (the words of names) are checked together."""
    space = F.when(F.col("kind").rlike("^(given|surname)"), F.lit("name")).otherwise(F.col("kind"))
    open_ = entities.select("kind", "canon", space.alias("space"), F.lit(0).alias("salt"))
    for _ in range(MAX_ROUNDS):
        tried = written(open_.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.col("salt"))), "tried")
        first = F.min(F.struct("canon", "kind"))
        winner = tried.groupBy("space", "surrogate").agg(first.alias("first"), F.count("*").alias("n"))
        shared = winner.filter("n > 1").select("space", "surrogate", "first")
        real = tried.select("space", F.col("canon").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        checked = written(
            tried.join(shared, ["space", "surrogate"], "left").join(real, ["space", "surrogate"], "left")
            .withColumn("lost", F.coalesce("real", F.lit(False)) | (F.col("first").isNotNull() & (F.col("first") != F.struct("canon", "kind"))))
            .select("kind", "canon", "space", "salt", "surrogate", "lost"), "checked")
        if checked.filter("lost").isEmpty():
            return checked.select("kind", "canon", "surrogate")
        open_ = checked.select("kind", "canon", "space", (F.col("salt") + F.col("lost").cast("int")).alias("salt"))
    left = sorted(r.kind for r in checked.filter("lost").select("kind").distinct().collect())
    raise ValueError(f"no distinct surrogates are left for {', '.join(left)} after {MAX_ROUNDS} rounds")


def pseudonymise(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its texts; all other columns stay (an ``n_chars`` column is set to the new
    length).  ``count`` names a column for the number of entities in a text; one of that name in ``docs`` is
    replaced.

    Null texts stay null; texts without an entity are unchanged.  Repeated rows give equal rows.  The same key gives
    the same surrogates for the same data; another key gives others.
    """
    names = [c for c in docs.columns if c != count]
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    other = docs.filter(~hinted)
    # The other columns travel in a struct, so their names cannot clash with the ones used here.
    apart = docs.filter(hinted).select(
        F.struct(*[F.col(f"`{c}`") if c != "text" else F.lit(None).cast("string").alias(c) for c in names]).alias("rest"),
        F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"),
        F.split("text", PATTERN, -1).alias("gaps"))
    apart = written(apart.withColumn("row", F.monotonically_increasing_id()), "apart")
    mentions = (apart.select("row", F.posexplode("found").alias("nth", "surface"))
                .withColumn("type", type_of(F.col("surface")))
                .select("row", "nth", F.posexplode(parts_of(F.col("type"), F.col("surface"))).alias("part", "p"))
                .select("row", "nth", "part", F.col("p.text").alias("surface"), F.col("p.kind").alias("kind"))
                .withColumn("word", F.when(F.col("kind").rlike("^(given|surname)"), F.trim("surface")).otherwise(F.col("surface")))
                .withColumn("canon", canonical(F.col("kind"), F.col("word"))))
    mentions = written(mentions, "mentions")
    assigned = assign(mentions.filter("kind is not null").select("kind", "canon").distinct(), key)
    # Titles and spaces keep their text; the space after a word of a name is put back.
    replaced = mentions.join(assigned, ["kind", "canon"], "left").withColumn("text", F.when(F.col("kind").isNull(), F.col("surface")).otherwise(
        F.concat(in_format(F.col("kind"), F.col("word"), F.col("surrogate")), F.substring(F.col("surface"), F.length("word") + 1, F.length("surface")))))
    by_row = replaced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "part", "text"))).alias("parts"))
    joined = apart.join(by_row, "row", "left")
    # Each gap goes before the first piece of its mention; the last one ends the text.
    pieces = F.transform("parts", lambda p: F.concat(
        F.when(p["part"] == 0, F.element_at("gaps", p["nth"] + 1)).otherwise(""), p["text"]))
    text = F.when(F.col("parts").isNull(), F.element_at("gaps", 1)).otherwise(
        F.concat(F.array_join(pieces, ""), F.element_at("gaps", -1)))
    n_found = F.size("found")
    out, changed = [], []
    for c in names:
        old = F.col("rest").getField(c)
        if c == "text":
            old = text
        elif c == "n_chars":
            old = F.when(n_found > 0, F.length(text)).otherwise(old).cast(dict(docs.dtypes)[c])
        out.append(F.col(f"`{c}`"))
        changed.append(old.alias(c))
    if count:
        out.append(F.lit(0).cast("long").alias(count))
        changed.append(n_found.cast("long").alias(count))
    return other.select(*out).union(joined.select(*changed))
